"""Sharding by weighted rendezvous hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 65_536


def _unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the largest rendezvous score weight / -ln(u) of (shard, key).

    u depends on the shard and the key alone, so a further shard takes rows
    only into itself, and a shard's share of the keys is that of its weight.
    A null key is a key of its own. Of equal scores the higher shard wins.
    """
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    scores = [F.struct((F.lit(float(w)) / -F.log(_unit(text, str(i)))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_max(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)


def sharded(docs: DataFrame, weights: list[float], doc_id: str = "doc_id", text: str = "text", grow_by: float | None = None) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1, ``text_crc32`` the
    unsigned CRC-32 of those bytes, ``shard`` depends on doc_id and the
    weights, and ``grown_shard`` is the shard with one more of weight
    ``grow_by`` (the last weight if None). ``slot`` numbers a shard's rows from
    0 without gaps, in the order of a hash of (id, size, CRC) and these three;
    rows equal in all take the following slots. Null ids form one key. Other
    columns are not read; an empty table gives no rows.

    Rows equal in id, size and CRC are counted before they are moved. A shard
    is numbered in parts by that hash, PARTS over all shards, of which only
    the sums come together, so rows that repeat an id with different texts
    are numbered in many tasks.
    """
    bytes_ = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    grown = [*weights, weights[-1] if grow_by is None else grow_by]
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    place = F.md5(F.concat_ws(":", F.coalesce(F.concat(F.lit("k"), F.col("doc_id").cast("string")), F.lit("null")), "size", "text_crc32").cast("binary"))
    parts = max(1, PARTS // len(weights))
    rows = rows.select(
        "*",
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
        place.alias("place"),
        (F.conv(F.substring(place, 1, 6), 16, 10).cast("long") * parts / (1 << 24)).cast("int").alias("bucket"),
    )
    sums = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
    before = "sum(total) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding)"
    offsets = sums.select("shard", "bucket", F.coalesce(F.expr(before), F.lit(0)).alias("base"))
    order = "partition by shard, bucket order by place, doc_id, size, text_crc32"
    inside = F.coalesce(F.expr(f"sum(n) over ({order} rows between unbounded preceding and 1 preceding)"), F.lit(0))
    placed = rows.withColumn("within", inside).join(F.broadcast(offsets), ["shard", "bucket"])  # PARTS rows of three numbers at most
    chunk = 100_000  # copies come in two steps, so that no array grows with their number
    copies = placed.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {chunk}"))))
    copies = copies.withColumn("i", F.explode(F.sequence(F.col("c") * chunk, F.least(F.col("n"), (F.col("c") + 1) * chunk) - 1)))
    return copies.select(
        F.col("doc_id").alias(doc_id), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("within") + F.col("i")).cast("long").alias("slot"), "grown_shard"
    )


def oracle(shards: int = 16) -> str:
    """DuckDB SQL of ``sharded`` over documents with equal weights."""
    unit = "(cast(('0x' || substr(md5('{i}:' || key), 1, 13)) as bigint) + 0.5) / 4503599627370496.0"
    score = lambda n: ", ".join(f"{{'score': 1.0 / -ln({unit.format(i=i)}), 'shard': {i}}}" for i in range(n))
    step = "case when {x} & 1 = 1 then xor({x} >> 1, 3988292384) else {x} >> 1 end"
    names = [f"t{j + 1} as (select i, {step.format(x='c')} as c from t{j})" for j in range(8)]
    tables = "t0 as (select i, i as c from range(256) r(i)), " + ", ".join(names) + ", crc_table as (select list(c order by i) as t from t8)"
    return f"""
with {tables},
octets as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
listed as (select doc_id, octet_length(encode(text)) + 1 as size,
    list_prepend(4294967295::bigint, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::int + 1, 2))::bigint)) as b from octets),
rows_ as (select doc_id, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32,
    coalesce('k' || cast(doc_id as varchar), 'null') as key from listed, crc_table),
placed as (select doc_id, size, text_crc32, md5(key || ':' || size || ':' || text_crc32) as place,
    list_max([{score(shards)}]).shard as shard, list_max([{score(shards + 1)}]).shard as grown_shard from rows_)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, cast(shard as integer) as shard,
    row_number() over (partition by shard order by place, doc_id, size, text_crc32) - 1 as slot, cast(grown_shard as integer) as grown_shard from placed
"""
