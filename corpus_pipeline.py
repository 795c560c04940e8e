"""A corpus pipeline: toxic documents go, near copies go, recurring passages go, benchmark leaks go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
has kept. All but the last return the columns of documents; further columns
are not read. Rows without text or id pass every filter and are packed; an
empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.decontam import contaminated
from strandloom.llm.neardup import similar_classes
from strandloom.llm.packing import packed
from strandloom.llm.queries import vocabulary_path
from strandloom.llm.repeats import without_repeats
from strandloom.llm.scratch import shared_dir
from strandloom.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ("lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of id and text, so that rows that share an id are judged each; null ids sort last."""
    return docs.withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted as toxic."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7, keep=("text", *REST))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id; of rows with equal id and text that with the smallest lang, source and n_chars. Rows without words stay."""
    worded = F.coalesce(F.col("text").rlike(r"[^ \x09-\x0D]"), F.lit(False))
    keyed = _keyed(docs.where(worded))
    gone = similar_classes(keyed, doc_id="key", shingle=5, percent=80).where("not kept").select("key").distinct()
    kept = keyed.join(gone, "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"), F.min(F.struct(*REST)).alias("rest"))
    return kept.select("key.doc_id", "text", *(f"rest.{c}" for c in REST)).unionByName(docs.where(~worded).select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those with recurring passages of 35 words without them."""
    done = without_repeats(docs, keep=REST)
    cut = F.col("n_removed") > 0
    return done.select("doc_id", F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    keyed = _keyed(docs)
    found = contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key", phrase_words=5)  # a short phrase is no leak
    return keyed.join(found.select("key").distinct(), "key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents, with their token ids, in sequences of 1024 tokens."""
    return packed(docs, vocabulary_path(), size=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Training, hashing of bands and tokenizing have no SQL form.
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again, and goes when the next one stands."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _remove(spark, last)
        last = path
    return docs
