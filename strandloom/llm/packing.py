"""Order-preserving packing of documents into training sequences by dynamic programming.

Documents follow each other in stored order. A window of at most ``size``
tokens ends behind a document or behind a sentence; it may end elsewhere only
where no document or sentence end lies within a whole window before. Each kind
of cut has a penalty in padding tokens. With positions c and windows (i, j], the least total of padding and penalties is

    best[j] = penalty[j] + size - c[j] + min(best[i] + c[i])  over c[j] - c[i] <= size,

a sliding-window minimum, kept in a monotone queue: linear time in the cuts.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import kernel

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000
SENTENCE_END = re.compile(rb"[.!?][\"')\]]*$")
FULL_STOPS = tuple(x.encode() for x in "。！？")


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts by a byte-level BPE file, as the tokenizers library gives them by default.

    The file's added tokens in a text have their own ids. Runs between single
    spaces never share a pre-token, so their ids are kept by run.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        if any(t[f] for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added tokens of {path} take or need text beside them")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.names = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        self.ends = np.zeros(size + 1, np.uint8)  # 1: ends a sentence where white space follows, 2: in any case
        self.opens = np.zeros(size + 1, bool)  # starts with white space
        for token, i in ranks.items():
            self.length[i] = len(token)
            self.ends[i] = 2 if b"\n" in token or token.endswith(FULL_STOPS) else bool(SENTENCE_END.search(token))
            self.opens[i] = token[:1].isspace()
        self.later: dict[str, bytes | None] = {}
        self.first: dict[str, bytes | None] = {}

    def _plain(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _learn(self, runs: set[str]) -> None:
        if len(self.later) > CACHE:
            self.later.clear()
            self.first.clear()
        new = [r for r in runs if r not in self.later]
        odd = [r for r in new if not r or r[0].isspace() or r[-1].isspace()]
        self.later.update(dict.fromkeys(odd))
        new = [r for r in new if r not in self.later]
        if new:
            ids = self.bpe.encode_to_numpy(" " + " ".join(new), disallowed_special=()).astype("<u4")
            stop = np.cumsum(self.length[ids])
            cut = np.searchsorted(stop, np.cumsum([len(r.encode()) + 1 for r in new])) + 1
            raw, at = ids.tobytes(), 0
            for r, c in zip(new, cut.tolist(), strict=True):
                self.later[r] = raw[4 * at : 4 * c]
                at = c

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none for null."""
        named = [i for i, t in enumerate(texts) if t and any(name in t for name in self.added)]
        if not named:
            return self._ordinary(texts)
        rest = list(texts)
        for i in named:
            rest[i] = None
        out = self._ordinary(rest)
        for i in named:
            pieces = self.names.split(texts[i])
            ids = self._ordinary(pieces[::2])
            out[i] = ids[0] + b"".join(self.added[name] + x for name, x in zip(pieces[1::2], ids[1:], strict=True))
        return out

    def _ordinary(self, texts: list[str | None]) -> list[bytes]:
        cut = [t.split(" ") if t else [] for t in texts]
        self._learn({r for runs in cut for r in runs[1:]})
        out = []
        for text, runs in zip(texts, cut, strict=True):
            if not text:
                out.append(b"")
                continue
            start = runs[0]
            if start not in self.first:
                self.first[start] = None if not start or start[0].isspace() or start[-1].isspace() else self._plain(start)
            head = self.first[start]
            try:
                out.append(head + b"".join(map(self.later.__getitem__, runs[1:])))
            except TypeError:  # spaces beside other white space: a pre-token may reach over them
                out.append(self._plain(text))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(position: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Ends of the windows (indices into position, which starts at 0 and rises by at most size)."""
    c, extra = position.tolist(), penalty.tolist()
    best, back = [0] * len(c), [0] * len(c)
    queue: deque[int] = deque([0])
    key = [0] * len(c)
    for j in range(1, len(c)):
        low = c[j] - size
        while c[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        b = key[i] + extra[j] + size - c[j]
        best[j], back[j] = b, i
        k = key[j] = b + c[j]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], len(c) - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def places(ids: np.ndarray, enc: Encoder, doc_end: np.ndarray, size: int, gap: int, sentence: int, hard: int) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cut positions and their penalties: ends of documents, of sentences, and others only where the ``size`` tokens before hold none of these."""
    known = np.minimum(ids, len(enc.ends) - 1)
    kind = enc.ends[known]
    marks = np.flatnonzero((kind == 2) | (kind == 1) & np.append(enc.opens[known[1:]], False)) + 1
    at = np.union1d(np.append(marks, 0), doc_end)
    wide = np.flatnonzero(np.diff(at) > size)
    more = [np.arange(at[i] + size, at[i + 1], gap) for i in wide]
    full = np.union1d(at, np.concatenate(more)) if more else at
    penalty = np.where(np.isin(full, at, assume_unique=True), sentence, hard)
    penalty[np.searchsorted(full, doc_end)] = 0
    penalty[0] = 0
    return full, penalty


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 1024, gap: int = 16, sentence: int = 4, hard: int = 8, block: int = 2_000_000, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with ids if asked for.

    A document is its token ids, the file's added tokens among them, and a final
    id 0, so a null or empty text is one token. ``sentence`` and ``hard`` are
    the padding tokens that a cut inside a document is worth; hard cuts are
    ``gap`` tokens apart, from a whole window behind the last end on. Sequences never cross partitions of the input or, within one,
    blocks of about ``block`` tokens; each of these ends with at most one short
    sequence. Rows that repeat are packed each; ids of any type, also null, are
    carried along. Other columns are not read. An empty table gives no rows.
    sequence_id holds the partition number in its upper bits.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        names: list[pa.Array] = []
        parts: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            ids = np.frombuffer(b"".join(parts), "<u4")
            length = np.array([len(p) for p in parts], np.int64) // 4
            doc_end = np.cumsum(length)
            at, penalty = places(ids, enc, doc_end, size, gap, sentence, hard)
            stop = at[cuts(at, penalty, size)]
            edge = np.union1d(stop, doc_end)
            begin = np.append(0, edge[:-1])
            doc = np.searchsorted(doc_end, begin, "right")
            window = np.searchsorted(stop, begin, "right")
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin.tolist(), edge.tolist(), strict=True)]
            first = np.append(0, stop[:-1])
            keys = pa.concat_arrays(names).take(pa.array(doc))
            cols = [keys, begin - (doc_end - length)[doc], edge - begin, np.array(crc, np.int64), length[doc], sequence + window, begin - first[window]]
            titles = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            out = [cols[0], *(pa.array(c.astype(np.int64)) for c in cols[1:])]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, edge).astype(np.int32)), pa.array(ids.astype(np.int32))))
                titles.append("ids")
            sequence += len(stop)
            return pa.RecordBatch.from_arrays(out, names=titles)

        for batch in kernel.sliced(batches, 1, rows=1000, size=2 << 20):
            coded = [x + b"\0\0\0\0" for x in enc(batch.column(1).to_pylist())]
            names.append(batch.column(0))
            parts += coded
            tokens += sum(map(len, coded)) // 4
            if tokens >= block:
                yield flush()
                names, parts, tokens = [], [], 0
        if parts:
            yield flush()

    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(doc_id, text).mapInArrow(run, fields).withColumnRenamed("doc_id", doc_id)
