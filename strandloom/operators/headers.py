"""Read names: tokens, field profile, and a column codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import durable

SPLIT = "[ ./:#+]"
NUMBER = "^(0|[1-9][0-9]{0,17})$"
DICTIONARY = 65_536


def trimmed(head: Column) -> Column:
    """Name up to the first space."""
    return F.substring_index(head, " ", 1)


def tokens(reads: DataFrame) -> DataFrame:
    """read_id, field, token, separator that follows ('' after the last)."""
    seps = F.regexp_extract_all("head", F.lit(f"({SPLIT})"), F.lit(1))
    rows = reads.select("read_id", seps.alias("seps"), F.posexplode(F.split("head", SPLIT)).alias("field", "token"))
    return rows.select("read_id", "field", "token", F.coalesce(F.try_element_at("seps", F.col("field") + 1), F.lit("")).alias("separator"))


def profile(reads: DataFrame) -> DataFrame:
    """Per field: is_numeric, is_const, separator, min_val, max_val, n_values.

    A field is numeric if all its tokens are plain decimal numbers, else it is
    a token field (mixed fields too). Distinct tokens are counted after a
    first grouping by token, so no task holds a field's whole value set.
    """
    by_token = tokens(reads).groupBy("field", "token").agg(F.min("separator").alias("separator"))
    number = F.col("token").rlike(NUMBER)
    value = F.when(number, F.col("token").cast("long"))
    rows = by_token.groupBy("field").agg(
        F.bool_and(number).alias("is_numeric"), (F.count("*") == 1).alias("is_const"), F.min("separator").alias("separator"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n_values")
    )
    numeric = F.col("is_numeric")
    return rows.select("field", "is_numeric", "is_const", "separator", F.when(numeric, F.col("lo")).alias("min_val"), F.when(numeric, F.col("hi")).alias("max_val"), "n_values")


def pair_field(reads: DataFrame) -> DataFrame:
    """One row: the last numeric field with values 1 to 2, else 0."""
    found = profile(reads).where("is_numeric and min_val = 1 and max_val = 2")
    return found.agg(F.coalesce(F.max("field"), F.lit(0)).alias("pe_field"))


PREFIX = 4


def _split(reads: DataFrame, fields: int) -> DataFrame:
    """read_id and t0, t1...: the fields of each name, null where a name has fewer."""
    parts = F.split("head", SPLIT)
    return reads.select("read_id", *(F.get(parts, F.lit(i)).alias(f"t{i}") for i in range(fields)))


def dictionary_of(reads: DataFrame, fields: DataFrame) -> DataFrame:
    """field, token, place of token fields: the place in the field's sorted value set, counted in parts of one prefix each."""
    held = tokens(reads).join(F.broadcast(fields.where("not is_numeric").select("field")), "field").select("field", "token", F.substring("token", 1, PREFIX).alias("part")).distinct()
    sizes = held.groupBy("field", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.expr("sum(n) over (partition by field order by part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    within = F.expr("row_number() over (partition by field, part order by token)") - 1
    return held.withColumn("within", within).join(sizes.select("field", "part", before.alias("base")), ["field", "part"]).select("field", "token", (F.col("base") + F.col("within")).cast("long").alias("place"))


class Codec:
    """Names as a code a field: numbers without their minimum, tokens as their place in the field's dictionary.

    A read stays one row: numbers are arithmetic on the name, tokens one join
    a token field that varies (a broadcast up to DICTIONARY values). Fields
    that every read has alike have no code. The profile is a row a field.
    """

    def __init__(self, reads: DataFrame):
        self.profile = durable(profile(reads))
        self.fields = sorted(self.profile.collect(), key=lambda r: r["field"])
        by_size = {r["n"]: r["count"] for r in reads.groupBy(F.size(F.split("head", SPLIT)).alias("n")).count().collect()}  # a row a number of fields
        least = min(by_size, default=0)
        self.moving = [r for r in self.fields if not r["is_const"] or r["field"] >= least]
        self.words = [r for r in self.moving if not r["is_numeric"]]
        self.dictionary = durable(dictionary_of(reads, self.profile.where(F.col("field").isin([r["field"] for r in self.words]))))
        self.constants = {r["field"]: r["token"] for r in self.profile.where("is_const").join(tokens(reads), "field").select("field", "token").distinct().collect()}

    def _joined(self, rows: DataFrame, field, have: str, want: str, key: str, value: str) -> DataFrame:
        some = self.dictionary.where(F.col("field") == field["field"]).select(F.col(key).alias(have), F.col(value).alias(want))
        return rows.join(F.broadcast(some) if field["n_values"] <= DICTIONARY else some, have, "left")

    def encode(self, reads: DataFrame) -> DataFrame:
        """read_id and c<field> of the fields that vary or that some reads lack; null where a name has fewer fields."""
        rows = _split(reads, len(self.fields))
        for r in self.words:
            rows = self._joined(rows, r, f"t{r['field']}", f"c{r['field']}", "token", "place")
        numbers = {r["field"]: F.expr(f"try_cast(t{r['field']} as bigint)") - F.lit(r["min_val"]) for r in self.moving if r["is_numeric"]}
        return rows.select("read_id", *((numbers[r["field"]] if r["is_numeric"] else F.col(f"c{r['field']}")).alias(f"c{r['field']}") for r in self.moving))

    def decode(self, codes: DataFrame) -> DataFrame:
        """read_id, head."""
        for r in self.words:
            codes = self._joined(codes, r, f"c{r['field']}", f"t{r['field']}", "place", "token")
        moving = {r["field"] for r in self.moving}
        parts = []
        for r in self.fields:
            i = r["field"]
            text = F.lit(self.constants[i]) if i not in moving else (F.col(f"c{i}") + F.lit(r["min_val"])).cast("string") if r["is_numeric"] else F.col(f"t{i}")
            parts.append(F.concat(text, F.lit(r["separator"])))
        return codes.select("read_id", F.concat_ws("", *parts).alias("head"))  # a null part is a field that the name lacks


def encoded(reads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(codes, fields, dictionary): read_id, field, code for fields that vary or that some reads lack, a row each; see ``Codec``."""
    codec = Codec(reads)
    each = F.array(*(F.struct(F.lit(r["field"]).alias("field"), F.col(f"c{r['field']}").cast("long").alias("code")) for r in codec.moving)) if codec.moving else F.array().cast("array<struct<field:int,code:long>>")
    return codec.encode(reads).select("read_id", F.explode(each).alias("x")).select("read_id", "x.*").where("code is not null"), codec.profile, codec.dictionary


def roundtrip(reads: DataFrame) -> DataFrame:
    codec = Codec(reads)
    return codec.decode(codec.encode(reads))


def mate_header(head: Column, field: int) -> Column:
    """Name of mate 2: the token of that field becomes 2; the separators stay."""
    return F.regexp_replace(head, f"^((?:[^ ./:#+]*{SPLIT}){{{field}}})1", "$12") if field == 0 else F.concat(F.regexp_extract(head, f"^((?:[^ ./:#+]*{SPLIT}){{{field}}})", 1), F.lit("2"), F.regexp_extract(head, f"^(?:[^ ./:#+]*{SPLIT}){{{field}}}[^ ./:#+]*(.*)$", 1))
