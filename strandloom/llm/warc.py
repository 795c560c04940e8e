"""WARC archives: a gzip member per record, written by partition and read back sequentially."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .scratch import durable, remove, shared_dir

REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
#: A payload of more rows than both HOT_ROWS and a part in HOT_SHARE of all repeats is hot, so there are at most HOT_SHARE of them.
HOT_ROWS, HOT_SHARE = 10_000, 1_000
#: Most payloads that repeat, and most files, of which a table is sent to all tasks; bits of the map of the former beyond that.
ROLES, FILES, MARK_BITS = 100_000, 100_000, 28


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    raw = b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _urn(page: str | None) -> str:
    """The name of a page's record: any text, percent-encoded; null is a name of another kind."""
    return "<urn:null:>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def _page(urn: str) -> str | None:
    return None if urn == "<urn:null:>" else unquote(urn.removeprefix("<urn:page:").removesuffix(">"))


def record_of(page: str | None, url: str, payload: bytes, size: int, digest: str, refers: str | None) -> bytes:
    """A response with its payload, or a revisit that names the response's record; size and digest are those of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if refers is None else b"")
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url:
        fields.append(("WARC-Target-URI", "".join(url.split())))
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers is not None:
        fields += [("WARC-Refers-To", _urn(refers)), ("WARC-Profile", PROFILE)]
    return _record(fields, block)


class Record:
    """One record that is taken in piece by piece: header, Content-Length bytes of block, two line ends.

    Only the header, and the payload where it is asked for, are held; the
    digests grow with the pieces. ``finish`` verifies all of them.
    """

    def __init__(self, payload: bool = True):
        self.head = bytearray()
        self.fields: dict[str, str] | None = None
        self.http: bytearray | None = bytearray()
        self.left, self.seen = 0, 0
        self.tail = bytearray()
        self.block, self.body = hashlib.sha256(), hashlib.sha256()
        self.payload = bytearray() if payload else None

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                return
            lines, data = self.head[:at].decode().split("\r\n"), bytes(self.head[at + 4 :])
            if lines[0] != "WARC/1.1":
                raise ValueError("not a WARC record")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            self.left = int(self.fields["Content-Length"])
        part, rest = data[: self.left], data[self.left :]
        self.left -= len(part)
        self.block.update(part)
        if self.http is not None:
            self.http += part
            at = self.http.find(b"\r\n\r\n")
            if at >= 0:
                part = bytes(self.http[at + 4 :])
                self.stated = int(dict(x.split(": ", 1) for x in self.http[:at].decode().split("\r\n")[1:])["Content-Length"])
                self.http = None
        if self.http is None:
            self.body.update(part)
            self.seen += len(part)
            if self.payload is not None:
                self.payload += part
        self.tail += rest
        if len(self.tail) > 4:
            raise ValueError("content length does not frame the record")

    def finish(self) -> dict:
        """Fields and payload; an error if framing or a digest does not hold."""
        if self.fields is None or self.left or self.tail != b"\r\n\r\n" or self.http is not None:
            raise ValueError("content length does not frame the record")
        fields = self.fields
        if fields["WARC-Block-Digest"] != f"sha256:{self.block.hexdigest()}":
            raise ValueError("block digest differs")
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if fields["WARC-Type"] == "response" and (self.seen != self.stated or self.body.hexdigest() != digest):
            raise ValueError("payload digest differs")
        name = lambda k: _page(fields[k]) if k in fields else None
        got = {"page": name("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "refers": name("WARC-Refers-To"), "digest": digest, "bytes": self.stated}
        return got | ({"payload": bytes(self.payload)} if self.payload is not None else {})


def records(stream, payload: bool = True) -> Iterator[dict]:
    """The records of a stream of gzip members: each member is inflated CHUNK bytes at a time into its record."""
    z, record = zlib.decompressobj(31), None
    data = b""
    while data or (data := stream.read(CHUNK)):
        record = record or Record(payload)
        record.feed(z.decompress(data, CHUNK))
        if z.eof:
            yield record.finish()
            data, z, record = z.unused_data, zlib.decompressobj(31), None
        else:
            data = z.unconsumed_tail
    if record:
        raise ValueError("archive ends within a record")


def _roles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The response (low, low_url, and same: the number of rows with both) of each payload that repeats: of hot ones, at most HOT_SHARE of them, and of the others."""
    light = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes", "page_id", "url").agg(F.count("*").alias("same"))
    counts = light.groupBy("digest", "bytes").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "same"))).alias("r"), F.sum("same").alias("n"))
    counts = durable(counts.where("n > 1 and r is not null").select("digest", "bytes", F.col("r.page_id").alias("low"), F.col("r.url").alias("low_url"), F.col("r.same").alias("same"), "n"))
    least = max(HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    return counts.where(F.col("n") > least).drop("n"), counts.where(F.col("n") <= least).drop("n")


def _marked(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """rows with marked: whether a bit map of MARK_BITS bits, in rows of 4 KB, has the digest's bit. A false mark costs a shuffled row, no more."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MARK_BITS)) + 1
    maps = roles.select(cell("digest").alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("map"))
    held = rows.withColumn("cell", cell("digest")).withColumns({"bucket": F.bitmap_bucket_number("cell"), "bit": F.bitmap_bit_position("cell")})
    byte = F.conv(F.hex(F.substr("map", F.expr("int(bit div 8 + 1)"), F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.getbit(byte, F.expr("int(bit % 8)")) == 1, F.lit(False))
    return held.join(F.broadcast(maps), "bucket", "left").withColumn("marked", set_).drop("bucket", "cell", "bit", "map")  # 32 MB at most


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive a table (page_id, url, html); one row (path, records) for each file.

    The payload is html in UTF-8; null is empty. Of the rows with equal
    payloads of at least REVISIT_BYTES bytes, that with the smallest page_id
    is the response and the others are revisits that refer to it; smaller
    payloads are all responses. Of several rows with that page_id, the one
    with the smallest url is the response, and of equal rows any one. A null
    page_id never is the smallest: such rows refer to the smallest, or are
    responses when all ids are null. Each task writes a file under a name of
    its own and only files of successful tasks are listed, so a lost executor
    leaves no record twice. An empty table gives no files. Other columns are
    not read. The folder stays until its owner removes it.

    Which payloads repeat is found on digests alone. The roles of up to ROLES
    such payloads are broadcast, so no payload is moved; of more, only rows
    whose digest a bit map of fixed size marks are joined by it. A payload
    that very many rows repeat is matched by a broadcast of at most HOT_SHARE
    rows. Page ids may be any text (they are percent-encoded).
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", url.alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    hot, others = _roles(rows.drop("payload"))
    rows = rows.join(F.broadcast(hot.select("digest", F.col("low").alias("h"), F.col("low_url").alias("h_url"))), "digest", "left")
    roles = others.select("digest", "low", "low_url")
    if others.count() <= ROLES:
        rows = rows.join(F.broadcast(roles), "digest", "left")
    else:  # only rows that the map marks, and no hot ones, are moved
        marked = _marked(rows, others)
        alone = (~F.col("marked")) | F.col("h").isNotNull()
        none = {c: F.lit(None).cast(roles.schema[c].dataType) for c in ("low", "low_url")}
        rows = marked.where(~alone).join(roles, "digest", "left").unionByName(marked.where(alone).withColumns(none)).drop("marked")
    rows = rows.withColumns({"low": F.coalesce("h", "low"), "low_url": F.coalesce("h_url", "low_url")})
    is_low = F.coalesce((F.col("page_id") == F.col("low")) & (F.col("url") == F.col("low_url")), F.lit(False))
    long_ = F.col("bytes") >= REVISIT_BYTES
    page = F.col("page_id").cast("string").alias("page")

    def shaped(df: DataFrame, revisit: Column) -> DataFrame:
        return df.select(page, "url", F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload")).alias("payload"), "bytes", "digest", F.when(revisit, F.col("low").cast("string")).alias("refers"))

    records_ = shaped(rows, long_ & F.col("low").isNotNull() & ~is_low)
    again = hot.unionByName(others).where("same > 1")
    if again.limit(1).count():  # several rows have the response's id and url: one of them stays the response
        keys = ["page_id", "url", "digest"]
        same = again.select(F.col("low").alias("page_id"), F.col("low_url").alias("url"), "digest", "bytes", F.col("same").alias("n"))
        rest = rows.join(same.select(*keys, F.lit(True).alias("repeats")), keys, "left").where(F.col("repeats").isNull())
        one = pages.select("page_id", url.alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")).join(same.select(*keys, "bytes"), keys).dropDuplicates(keys)
        # the repeats of equal rows are revisits, which carry no payload: their number is enough
        steps = same.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 2) div 100000"))))
        steps = steps.withColumn("i", F.explode(F.sequence(F.col("c") * 100_000, F.least(F.col("n") - 1, (F.col("c") + 1) * 100_000) - 1)))
        records_ = (
            shaped(rest, long_ & F.col("low").isNotNull() & ~is_low)
            .unionByName(one.select(page, "url", "payload", "bytes", "digest", F.lit(None).cast("string").alias("refers")))
            .unionByName(steps.select(page, "url", F.lit("").cast("binary").alias("payload"), "bytes", "digest", F.col("page_id").cast("string").alias("refers")))
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        path, n, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in kernel.sliced(batches, 2):
            for row in zip(*batch.columns, strict=True):
                out = out or system.open_output_stream(path, compression=None)
                out.write(record_of(*(x.as_py() for x in row)))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([n])], names=["path", "records"])

    return durable(records_.mapInArrow(run, "path string, records long"))


def read_warc(files: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the listed archives (column path): page, url, type, refers, digest, bytes, and payload if asked for.

    A task reads a file (two or more beyond FILES), once, in order, and holds CHUNK bytes of it and the
    records of an output batch; a record that is cut short, framed wrongly or
    fails a digest stops the read. Revisits have the stated length and digest
    of the full payload, and no payload. An empty list gives no rows.
    """
    names = ["page", "url", "type", "refers", "digest", "bytes", *["payload"] * payload]
    kinds = {"bytes": pa.int64(), "payload": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _open(path)
                rows, size = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for record in records(stream, payload):
                        rows.append(record)
                        size += 300 + len(record.get("payload", b""))
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "page string, url string, type string, refers string, digest string, bytes long" + ", payload binary" * payload
    n = files.count()
    if n > FILES:
        return files.select("path").repartition(n).mapInArrow(run, schema)
    # the partitions of a range hold a number each, and a broadcast of at most FILES names leaves them so
    named = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("id"))
    return files.sparkSession.range(0, n, 1, max(1, n)).join(F.broadcast(named), "id").select("path").mapInArrow(run, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Per page, from the archives as read back: page_id, payload_bytes, payload_digest, record_type, refers_to. The archives go when all are read."""
    kind = pages.schema["page_id"].dataType.simpleString()
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records = read_warc(write_warc(pages, folder), payload=False)
    number = lambda c: F.col(c).cast(kind)
    out = durable(records.select(number("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers").alias("refers_to")))
    remove(spark, folder)
    return out


ORACLE = """
with p as (select page_id, coalesce(url, '') as url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
q as (select *, min(page_id) over (partition by payload_digest) as low, row_number() over (partition by payload_digest order by page_id nulls last, url) as place from p)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= 100 and low is not null and place > 1 then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 100 and low is not null and place > 1 then low end as refers_to
from q
"""
