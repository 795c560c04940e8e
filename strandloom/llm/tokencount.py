"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

The forward score of a prefix (the best sum of piece scores that spells it)
depends on the prefix alone. Distinct pre-tokens are inserted in a trie, each
new node computes its forward score once from the nodes above it, and the node
where a pre-token ends holds its number of tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import kernel

SPACE = "▁"
UNKNOWN = -30.0


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, float]:
    """Pieces with the log-probability of their rank under Zipf's law.

    The file gives an order of pieces, no probabilities; control, unknown and
    byte pieces are left out.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = sum(1 / (i + 2) for i in range(len(names)))
    return {name: -math.log((i + 2) * total) for i, name in enumerate(names)}


class Trie:
    """Pre-tokens with shared prefixes; ``count`` gives the tokens of one.

    A node has a forward score and the least number of tokens with that score.
    A character that no piece covers costs UNKNOWN and is as many tokens as it
    has bytes. At ``limit`` nodes the trie starts anew; results do not change.
    """

    def __init__(self, scores: dict[str, float], limit: int = 1_000_000):
        self.scores, self.limit = scores, limit
        self.longest = max(map(len, scores), default=1)
        self.made = 0
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]

    def _add(self, text: str, end: int, path: list[int]) -> int:
        """Node of text[:end]; path holds the nodes of its shorter prefixes."""
        c = text[end - 1]
        best = self.score[path[end - 1]] + UNKNOWN
        n = self.tokens[path[end - 1]] + len(c.encode("utf-8", "surrogatepass"))
        for start in range(max(0, end - self.longest), end):
            s = self.scores.get(text[start:end])
            if s is not None:
                p = path[start]
                total, m = self.score[p] + s, self.tokens[p] + 1
                if total > best or total == best and m < n:
                    best, n = total, m
        self.score.append(best)
        self.tokens.append(n)
        self.made += 1
        return len(self.score) - 1

    def count(self, text: str) -> int:
        if len(self.score) > self.limit:
            self._clear()
        path, child = [0], self.child
        for end in range(1, len(text) + 1):
            key = (path[-1], text[end - 1])
            node = child.get(key)
            if node is None:
                node = child[key] = self._add(text, end, path)
            path.append(node)
        return self.tokens[path[-1]]


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", long_words: int = 512) -> DataFrame:
    """Per row of docs: doc_id, n_pretokens, n_tokens.

    A pre-token is a run of characters that are not white space, with the mark
    of a preceding space in front; its tokens are those of the best-scoring
    split into pieces. Null, empty and blank texts have none. Pre-tokens over
    ``long_words`` characters are counted alike but not kept in the trie. Rows
    that repeat and null ids are counted each. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = pieces(vocabulary)
        trie = Trie(scores)
        known: dict[str, int] = {}
        for batch in kernel.sliced(batches, 1, rows=1000, size=2 << 20):
            if len(known) > 400_000:
                known.clear()
            words, tokens = [], []
            for t in batch.column(1).to_pylist():
                cut = Counter((t or "").split())
                n = 0
                for w, k in cut.items():
                    m = known.get(w)
                    if m is None:
                        if len(w) > long_words:
                            m = Trie(scores, limit=len(w) + 2).count(SPACE + w)
                        else:
                            m = known[w] = trie.count(SPACE + w)
                    n += k * m
                words.append(sum(cut.values()))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("doc_id", doc_id)
