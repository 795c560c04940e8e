"""FASTQ as a Spark data source ("fastq"): batch and streaming reads, and a committed sink.

    spark.dataSource.register(FastqSource)
    spark.read.format("fastq").option("paths", "a.fq;b.fq.gz").load()
    spark.read.format("fastq").option("paths", "a_1.fq").option("mates", "a_2.fq").load()
    spark.readStream.format("fastq").option("folder", "in").load()
    reads.write.format("fastq").option("path", "out").option("mate_path", "out_2").mode("append").save()

Which lines are records is decided by a few lines around them, so a file
gives the same rows however it is cut, and a malformed record costs no other.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..functions.counting import letters

SPLIT_BYTES, STEP, BEFORE, AFTER = 64 << 20, 4 << 20, 10, 6
#: Bytes behind a window that are read at first to see the AFTER lines there.
AHEAD = 16 << 10
#: Plain files are cut into about so many splits at most; longer ones then, since a task costs more than a small split.
SPLITS = 1024
NUMBER = re.compile(r"[^ ._,=:/#-]*[ ._,=:/#-]([0-9]{1,18})(?:[ ._,=:/#-]|$)")
FILE_SHIFT = 44
COLUMNS = ["read_id", "head", "seq", "qua", "mate_seq", "mate_qua", "bad"]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Lines:
    """Lines of a window of a file, and which of them begin records or malformed stretches.

    A record begins at a line with @ if the third line from it begins with +
    and the second and fourth have the same length; the second begins with
    neither @ nor +. Such records overlap only where a fourth line looks like
    the first of another: it is none. Other lines are blank or malformed; a malformed stretch begins at a line with @, and behind a record
    or a blank line.
    """

    base: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    record: np.ndarray
    covered: np.ndarray
    bad: np.ndarray

    @classmethod
    def of(cls, data: bytes, base: int) -> Lines:
        d = np.frombuffer(data, np.uint8)
        stop = np.flatnonzero(d == 10)
        if len(d) and (not len(stop) or stop[-1] != len(d) - 1):
            stop = np.append(stop, len(d))
        start = np.append(0, stop[:-1] + 1).astype(np.int64) if len(stop) else np.zeros(0, np.int64)
        end = stop - ((stop > start) & (d[np.maximum(stop - 1, 0)] == 13)) if len(stop) else stop
        n = len(start)
        first = np.where(end > start, d[np.minimum(start, max(len(d) - 1, 0))], 0) if n else np.zeros(0, np.uint8)
        size = end - start
        record = np.zeros(n + 4, bool)
        # a file may end behind the third line of a read without bases
        first_, size_ = np.append(first, [0] * 4), np.append(size, [0, -1, -1, -1])
        record[:n] = (first_[:n] == 64) & (first_[2 : n + 2] == 43) & (size_[1 : n + 1] == size_[3 : n + 3]) & ~np.isin(first_[1 : n + 1], (43, 64))
        record[3:] &= ~record[:-3].copy()
        covered = record[:n].copy()
        for j in (1, 2, 3):
            covered[j:] |= record[: max(0, n - j)]
        wrong = ~covered & (size > 0)
        after_other = np.append(True, ~wrong[:-1]) if n else wrong
        return cls(base, d, start, end, record[:n], covered, wrong & ((first == 64) | after_other))

    def own(self, marks: np.ndarray, lo: int, hi: int) -> np.ndarray:
        at = self.start + self.base
        return np.flatnonzero(marks & (at >= lo) & (at < hi))

    def bad_end(self, i: int) -> int:
        """The line behind the malformed stretch that begins at line i; the number of lines if it goes on beyond the window."""
        j = i + 1
        while j < len(self.start) and not self.covered[j] and not self.bad[j] and self.end[j] > self.start[j]:
            j += 1
        return j

    def column(self, i: np.ndarray) -> pa.Array:
        """The lines i as texts; bytes that are no UTF-8 are read as Latin-1."""
        edges = np.stack([self.start, self.end], axis=1).ravel()
        edges = np.append(edges, len(self.data)).astype(np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(self.data)])
        out = whole.take(pa.array(2 * i))
        if len(self.data) and self.data.max() >= 128:
            return pa.array([x.decode("latin-1") for x in out.to_pylist()], pa.string())
        return out.cast(pa.string())


class Window:
    """A file read forwards from a place, of which a window is held."""

    def __init__(self, stream, base: int):
        self.stream, self.base, self.data, self.ended = stream, base, b"", False

    def more(self, size: int) -> None:
        piece = self.stream.read(size)
        self.ended = not piece
        self.data += piece

    def lines(self, lo: int, hi: int) -> Lines:
        """Lines that decide what begins in [lo, hi); earlier ones but BEFORE are dropped."""
        at = lo - self.base
        for _ in range(BEFORE):
            at = self.data.rfind(b"\n", 0, max(0, at - 1)) + 1
        self.data, self.base = self.data[at:], self.base + at
        while True:
            while not self.ended and self.base + len(self.data) < hi + AHEAD:
                self.more(hi + AHEAD - self.base - len(self.data))
            seen, at = -1, hi - self.base
            while seen < AFTER and at >= 0 and at < len(self.data):
                at, seen = self.data.find(b"\n", at) + 1, seen + 1
                if not at:
                    at = -1
            if self.ended or at >= 0 and seen >= AFTER:
                found = Lines.of(self.data, self.base)
                bad = found.own(found.bad, lo, hi)
                if self.ended or not len(bad) or found.bad_end(int(bad[-1])) < len(found.start) - AFTER:
                    return found
            self.more(len(self.data) + AHEAD)


def _stream(path: str, start: int):
    system, name = _open(path)
    if path.endswith(".gz"):
        return gzip.GzipFile(fileobj=system.open_input_stream(name, compression=None))
    f = system.open_input_file(name)
    f.seek(start)
    return f


def _window(path: str, start: int) -> Window:
    """A window that holds BEFORE lines, or the file's beginning, in front of start."""
    if path.endswith(".gz") or not start:
        return Window(_stream(path, 0), 0)
    back = 1 << 16
    while True:
        a = max(0, start - back)
        with _stream(path, a) as f:
            head = f.read(start - a)
        if not a or head.count(b"\n") > BEFORE + 1:
            return Window(_stream(path, a), a)
        back *= 4


def _limited(path: str, limit: int | None):
    """Whether to take only so many bytes of a file that may still grow."""

    class Limited:
        def __init__(self, f, at):
            self.f, self.at = f, at

        def read(self, n):
            data = self.f.read(max(0, min(n, limit - self.at)))
            self.at += len(data)
            return data

    window = lambda start: _window(path, start)
    if limit is None:
        return window

    def held(start: int) -> Window:
        w = window(start)
        return Window(Limited(w.stream, w.base), w.base)

    return held


def batches(path: str, start: int = 0, stop: int | None = None, strict: bool = False, trim: bool = False, limit: int | None = None, names: bool = False) -> Iterator[pa.RecordBatch]:
    """(at, head, seq, qua, bad) of the records, and malformed stretches, that begin from start up to stop (the end), by byte offset; with ``names`` seq and qua are null."""
    window = _limited(path, limit)(start)
    lo = start
    while stop is None or lo < stop:
        hi = lo + STEP if stop is None else min(lo + STEP, stop)
        x = window.lines(lo, hi)
        good, wrong = x.own(x.record, lo, hi), x.own(x.bad, lo, hi)
        if strict and len(wrong):
            i = int(wrong[0])
            raise ValueError(f"malformed record at byte {x.base + x.start[i]} of {path}: {x.data[x.start[i] : x.end[i]].tobytes()[:80]!r}")
        head, at = x.column(np.append(good, wrong)), x.base + x.start[np.append(good, wrong)]
        if trim:
            head = pc.list_element(pc.split_pattern(head, " ", max_splits=1), 0) if len(head) else head
        text = [x.data[x.start[i] : x.end[x.bad_end(i) - 1]].tobytes().replace(b"\r\n", b"\n").decode("latin-1") for i in wrong.tolist()]
        padded = lambda c: pa.concat_arrays([c, pa.nulls(len(wrong), pa.string())])  # noqa: B023, E731
        last = np.append(x.start, len(x.data))
        quality = x.column(np.minimum(good + 3, len(x.start) - 1)) if len(good) and not names else pa.array([], pa.string())
        if len(quality) and good[-1] + 3 >= len(x.start):  # the fourth line of a last read without bases is not there
            quality = pa.concat_arrays([quality[:-1], pa.array([""])])
        bases = [pa.nulls(len(at), pa.string())] * 2 if names else [padded(x.column(good + 1)), padded(quality)]
        out = pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), head, *bases, pa.concat_arrays([pa.nulls(len(good), pa.string()), pa.array(text, pa.string())])], names=["at", "head", "seq", "qua", "bad"])
        if out.num_rows:
            yield out.take(pc.sort_indices(out.column(0))) if len(wrong) else out
        if window.ended and hi >= x.base + int(last[-1]):
            return
        lo = hi


def records(path: str, start: int = 0, stop: int | None = None, **options) -> Iterator[tuple[int, str, str | None, str | None, str | None]]:
    """As ``batches``, a tuple each."""
    for b in batches(path, start, stop, **options):
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def number_of(head: str) -> int | None:
    """The number between the first and the second separator of a name."""
    found = NUMBER.match(head)
    return int(found[1]) if found else None


def numbers_of(heads: pa.Array) -> pa.Array:
    """``number_of`` of each name."""
    return pc.struct_field(pc.extract_regex(heads, "^" + NUMBER.pattern.replace("([0-9]", "(?P<n>[0-9]")), 0).cast(pa.int64())


class Ahead:
    """Rows of batches (at, head, seq, qua, bad), some of them held, with the numbers in their names."""

    def __init__(self, of: Iterator[pa.RecordBatch]):
        self.of, self.rows, self.known, self.number, self.ended = of, None, None, None, False
        self.take(0)

    def take(self, n: int) -> pa.RecordBatch | None:
        """The first n rows; if none is left then, those of the next batch are held."""
        out = self.rows[:n] if self.rows is not None else None
        if out is not None:
            self.rows, self.known, self.number = self.rows[n:], self.known[n:], self.number[n:]
        while not self.ended and (self.rows is None or not self.rows.num_rows):
            self.rows = next(self.of, None)
            self.ended = self.rows is None
            if not self.ended:
                number = numbers_of(self.rows.column(1))
                self.known, self.number = number.is_valid().to_numpy(zero_copy_only=False), number.fill_null(0).to_numpy()
        return out


def _run(good: np.ndarray) -> int:
    """How many are True before the first that is not."""
    return int(np.append(good, False).argmin())


def in_step(first: Iterator[pa.RecordBatch], second: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, pa.RecordBatch | None]]:
    """Records of two mate files in pairs, as batches of equal size. Where the numbers in the names differ, the smaller one is given without a mate; so is the rest of the longer file."""
    a, b = Ahead(first), Ahead(second)
    while not (a.ended and b.ended):
        if a.ended or b.ended:
            yield (a.take(a.rows.num_rows), None) if b.ended else (None, b.take(b.rows.num_rows))
            continue
        n = min(a.rows.num_rows, b.rows.num_rows)
        n = _run(~(a.known[:n] & b.known[:n]) | (a.number[:n] == b.number[:n]))
        if n:
            yield a.take(n), b.take(n)
        elif a.number[0] < b.number[0]:
            yield a.take(_run(a.known & (a.number < b.number[0]))), None
        else:
            yield None, b.take(_run(b.known & (b.number < a.number[0])))


class _Piece(InputPartition):
    """Byte range of a file; of a pair, records of the first file in that range with those of the second one from ``mate_start`` on (up to ``mate_stop``) whose numbers are from lo up to hi, or after ``skip`` of them."""

    def __init__(self, index: int, path: str, mate: str | None, start: int, stop: int | None, limit: int | None = None, mate_start: int = 0, lo: int | None = None, hi: int | None = None, skip: int = 0, count: int | None = None, mate_stop: int | None = None):
        super().__init__((index, start))
        self.index, self.path, self.mate, self.start, self.stop, self.limit = index, path, mate, start, stop, limit
        self.mate_start, self.mate_stop, self.lo, self.hi, self.skip, self.count = mate_start, mate_stop, lo, hi, skip, count


def _files(paths: str) -> list[str]:
    """The named files; of a folder those in it, by name."""
    out = []
    for p in filter(None, paths.split(";")):
        system, name = _open(p)
        if system.get_file_info(name).type == pafs.FileType.Directory:
            inside = sorted(f.path for f in system.get_file_info(pafs.FileSelector(name)) if f.is_file and not f.base_name.startswith((".", "_")))
            out += [p.rstrip("/") + f[len(name.rstrip("/")) :] for f in inside]
        else:
            out.append(p)
    return out


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.mates = _files(options.get("paths", options.get("path", ""))), _files(options.get("mates", ""))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.trim = options.get("trim", "false").lower() == "true"
        self.split = int(options.get("split_bytes", str(SPLIT_BYTES)))
        self.names = options.get("names", "false").lower() == "true"
        self.cuts = json.loads(options.get("pair_cuts", "{}"))
        if self.mates and len(self.mates) != len(self.paths):
            raise ValueError("as many mate files as files are needed")

    def partitions(self):
        """Plain files are split by bytes (``split_bytes``, or more if these would be over SPLITS tasks), pairs of files where ``pair_cuts`` has places (see ``read_fastq``); gzip files are a task each."""
        out, sizes = [], [(lambda s, n: s.get_file_info(n).size or 0)(*_open(p)) for p in self.paths]
        split = max(self.split, -(-sum(n for p, n in zip(self.paths, sizes, strict=True) if not p.endswith(".gz")) // SPLITS))
        for i, (p, size) in enumerate(zip(self.paths, sizes, strict=True)):
            mate = self.mates[i] if self.mates else None
            if mate:
                out += [_Piece(i, p, mate, **cut) for cut in self.cuts.get(str(i), [{"start": 0, "stop": None}])]
            elif p.endswith(".gz") or size <= split:
                out.append(_Piece(i, p, None, 0, None))
            else:
                out += [_Piece(i, p, None, a, min(a + split, size)) for a in range(0, size, split)]
        return out

    def read(self, piece):
        if piece is None:  # no partitions
            return
        options = {"strict": self.strict, "trim": False if piece.mate else self.trim, "names": self.names}
        base = piece.index << FILE_SHIFT
        if not piece.mate:
            for b in batches(piece.path, piece.start, piece.stop, limit=piece.limit, **options):
                none = pa.nulls(b.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([pc.add(b.column(0), base), b.column(1), b.column(2), b.column(3), none, none, b.column(4)], names=COLUMNS)
            return
        yield from self._pairs(piece, options)

    def _pairs(self, piece, options) -> Iterator[pa.RecordBatch]:
        base = piece.index << FILE_SHIFT
        first, second = batches(piece.path, piece.start, piece.stop, **options), batches(piece.mate, piece.mate_start, piece.mate_stop, **options)
        if piece.lo is not None or piece.hi is not None:
            second = _between(second, piece.lo, piece.hi)
        elif piece.count is not None or piece.skip:
            second = _some(second, piece.skip, piece.count)
        for a, b in in_step(first, second):
            if piece.count is not None and (a is None or b is None):
                raise ValueError("mate files lack records of each other and are not in order of number: read them with split_pairs=False")
            if self.strict and (a is None or b is None):
                raise ValueError("mate files hold different records")
            one = a if a is not None else b
            head = pc.list_element(pc.split_pattern(one.column(1), " ", max_splits=1), 0) if self.trim else one.column(1)
            none = pa.nulls(one.num_rows, pa.string())
            if a is None or b is None:
                number, own = pc.add(one.column(0), base | (1 << FILE_SHIFT - 1 if a is None else 0)), [one.column(2), one.column(3)]
                yield pa.RecordBatch.from_arrays([number, head, *(own + [none, none] if b is None else [none, none] + own), pc.coalesce(one.column(4), f"no mate {1 if a is None else 2}")], names=COLUMNS)
            else:
                bad = pc.coalesce(a.column(4), b.column(4))
                yield pa.RecordBatch.from_arrays([pc.add(a.column(0), base), head, *(pc.if_else(bad.is_valid(), none, x.column(c)) for x in (a, b) for c in (2, 3)), bad], names=COLUMNS)

    def __getstate__(self):
        return self.__dict__ | {"paths": [], "mates": [], "cuts": {}}  # tasks have their pieces


def _between(rows: Iterator[pa.RecordBatch], lo: int | None, hi: int | None) -> Iterator[pa.RecordBatch]:
    """Rows with numbers, which rise, from lo up to hi."""
    for b in rows:
        number = numbers_of(b.column(1)).to_numpy()
        a, z = 0 if lo is None else int(np.searchsorted(number, lo)), len(number) if hi is None else int(np.searchsorted(number, hi))
        if a < z:
            yield b[a:z]
        if z < len(number):
            return


def _some(rows: Iterator[pa.RecordBatch], skip: int, count: int | None) -> Iterator[pa.RecordBatch]:
    seen = 0
    for b in rows:
        a, z = max(0, skip - seen), b.num_rows if count is None else min(b.num_rows, skip + count - seen)
        if a < z:
            yield b[a:z]
        seen += b.num_rows
        if count is not None and seen >= skip + count:
            return


class FastqStream(DataSourceStreamReader):
    """Files of a folder, which may grow and be joined by others; an offset holds the bytes of each that are taken.

    A file is taken up to the end of its last whole record, so a record, or
    malformed text, that is still being written waits; a batch is fixed by its
    two offsets and can be redone. Reading the end of a file takes TAIL bytes.
    """

    TAIL = 1 << 20

    def __init__(self, options):
        self.folder, self.strict = options["folder"], options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.split = int(options.get("split_bytes", str(SPLIT_BYTES)))
        self.sizes: dict[str, tuple[int, int]] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        for path in _files(self.folder):
            system, name = _open(path)
            size = system.get_file_info(name).size or 0
            known, end = self.sizes.get(path, (0, 0))
            if size == known:
                continue
            if path.endswith(".gz"):
                end = size
            else:
                a, tail = size, self.TAIL
                while a and end < size:
                    a = max(0, size - tail)
                    with _stream(path, a) as f:
                        x = Lines.of(f.read(size - a), a)
                    whole = np.flatnonzero(x.record)
                    whole = whole[whole + 4 <= len(x.start)]
                    ends = np.append(x.start, len(x.data))[np.minimum(whole + 4, len(x.start))]
                    closed = ends[(ends < len(x.data)) | (len(x.data) > 0 and x.data[-1] == 10)]
                    if len(closed) or not a:
                        end = max(end, a + int(closed[-1])) if len(closed) else end
                        break
                    tail *= 4
            self.sizes[path] = (size, end)
        return {path: end for path, (_, end) in self.sizes.items() if end}

    def partitions(self, start, end):
        out = []
        for i, (path, to) in enumerate(sorted(end.items())):
            a = start.get(path, 0)
            if path.endswith(".gz"):
                out += [_Piece(i, path, None, 0, None)] if not a else []
            else:
                out += [_Piece(i, path, None, x, min(x + self.split, to), to) for x in range(a, to, self.split)]
        return out

    def read(self, piece):
        if piece is None:
            return
        for b in batches(piece.path, piece.start, piece.stop, self.strict, limit=piece.limit):
            none = pa.nulls(b.num_rows, pa.string())
            file = int.from_bytes(uuid.uuid5(uuid.NAMESPACE_URL, piece.path).bytes[:2], "big")  # files may join between others
            yield pa.RecordBatch.from_arrays([pc.add(b.column(0), file << FILE_SHIFT), b.column(1), b.column(2), b.column(3), none, none, b.column(4)], names=COLUMNS)

    def commit(self, end):
        pass


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    names: list[list[str]]


class FastqWriter(DataSourceArrowWriter):
    """FASTQ files, a part a task, under a temporary name until all tasks have succeeded.

    With ``mate_path`` a task writes both mates of each row in the same order
    to files of the same name. ``kind`` "qualities" writes quality lines alone.
    """

    def __init__(self, options, overwrite: bool):
        self.folders = [options["path"], *([options["mate_path"]] if options.get("mate_path") else [])]
        self.gzip = options.get("compression", "none") == "gzip"
        self.qualities = options.get("kind", "reads") == "qualities"
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _texts(self, batch: pa.RecordBatch) -> list[bytes]:
        held = {c: batch.column(c) for c in batch.schema.names if c in ("head", "mate_head", "seq", "qua", "mate_seq", "mate_qua")}
        out = []
        for n in range(len(self.folders)):
            seq, qua = (held[f"mate_{c}" if n else c] for c in ("seq", "qua")) if not self.qualities else (held["mate_qua" if n else "qua"],) * 2
            head = held["mate_head"] if n and "mate_head" in held else held.get("head", pa.array([""] * batch.num_rows))
            if any(c.null_count for c in (head, seq, qua)):
                raise ValueError("a row without name, bases or qualities cannot be written; leave out rows with column bad")
            if not pc.utf8_length(seq).equals(pc.utf8_length(qua)):
                raise ValueError("bases and qualities differ in length")
            rows = pc.binary_join_element_wise(qua, "", "\n") if self.qualities else pc.binary_join_element_wise(head, seq, "+", qua, "", "\n")
            text = letters(rows)[0]
            out.append(text.tobytes() if not len(text) or text.max() < 128 else text.tobytes().decode().encode("latin-1"))
        return out

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        streams, names = None, [[] for _ in self.folders]
        for batch in iterator:
            if not batch.num_rows:
                continue
            if streams is None:
                streams = []
                for n, folder in enumerate(self.folders):
                    system, name = _open(folder)
                    place = f"{name.rstrip('/')}/_temporary-{self.job}"
                    system.create_dir(place, recursive=True)
                    names[n].append(f"{place}/{task.partitionId():06d}-{task.taskAttemptId()}")
                    raw = system.open_output_stream(names[n][0], compression=None)
                    streams.append(gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.gzip else raw)
                    if self.gzip:
                        streams[-1].under = raw
            for stream, text in zip(streams, self._texts(batch), strict=True):
                stream.write(text)
        for stream in streams or ():
            stream.close()
            if self.gzip:
                stream.under.close()
        return _Written(task.partitionId(), names)

    def commit(self, messages):
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        for n, folder in enumerate(self.folders):
            system, name = _open(folder)
            system.create_dir(name, recursive=True)
            if self.overwrite:
                for f in system.get_file_info(pafs.FileSelector(name)):
                    if f.is_file:
                        system.delete_file(f.path)
            for m in done:
                for held in m.names[n]:
                    system.move(held, f"{name.rstrip('/')}/part-{m.partition:06d}-{self.job}.{'txt' if self.qualities else 'fastq'}{'.gz' if self.gzip else ''}")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        for folder in self.folders:
            system, name = _open(folder)
            place = f"{name.rstrip('/')}/_temporary-{self.job}"
            if system.get_file_info(place).type == pafs.FileType.Directory:
                system.delete_dir(place)


class FastqSource(DataSource):
    """read_id: the file's number in the upper bits, then the record's byte offset (pairs: in the first file; of a second mate alone in its own, with a bit in front)."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "read_id long, head string, seq string, qua string, mate_seq string, mate_qua string, bad string"

    def reader(self, schema):
        return FastqReader(self.options)

    def streamReader(self, schema):
        return FastqStream(self.options)

    def writer(self, schema, overwrite):
        return FastqWriter(self.options, overwrite)


def read_fastq(spark, paths: list[str], mates: list[str] | None = None, split_pairs: bool = True, **options) -> DataFrame:
    """Reads of the files (or folders) in order; malformed stretches have column bad (PERMISSIVE) or stop the read (mode='FAILFAST').

    Plain mate files over ``split_bytes`` are indexed first, in a pass over
    both, and then cut at equal records (``pair_cuts``).
    """
    spark.dataSource.register(FastqSource)
    r = spark.read.format("fastq").option("paths", ";".join(paths))
    if mates:
        r = r.option("mates", ";".join(mates))
        if split_pairs:
            cuts = pair_cuts(spark, ";".join(paths), ";".join(mates), int(options.get("split_bytes", SPLIT_BYTES)))
            r = r.option("pair_cuts", json.dumps(cuts))
    for k, v in options.items():
        r = r.option(k, str(v))
    df = r.load()
    return df if mates else df.drop("mate_seq", "mate_qua")


def _index(spark, paths: list[str], split: int) -> list[list[tuple]]:
    """For each file, and each split of it that holds records: offset and number of its first record, its last number, records, and whether numbers rise."""
    schema = "at long, first long, last long, n long, rises boolean"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, last, n, rises = None, None, None, 0, True
        for b in frames:
            if not b.num_rows:
                continue
            x = numbers_of(b.column(1))
            rises = rises and not x.null_count and (last is None or x[0].as_py() > last) and bool((np.diff(x.to_numpy()) > 0).all())
            at, first = (b.column(0)[0].as_py(), x[0].as_py()) if at is None else (at, first)
            last, n = x[-1].as_py(), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([n]), pa.array([rises])], names=["at", "first", "last", "n", "rises"])

    rows = spark.read.format("fastq").option("paths", ";".join(paths)).option("split_bytes", str(split)).option("names", "true").load().select("read_id", "head").mapInArrow(run, schema)
    out: list[list[tuple]] = [[] for _ in paths]
    for at, *rest in sorted(tuple(r) for r in rows.collect()):  # a row a split
        out[at >> FILE_SHIFT].append((at & (1 << FILE_SHIFT) - 1, *rest))
    return out


def pair_cuts(spark, paths: str, mates: str, split: int) -> dict[str, list[dict]]:
    """Where the pairs of large plain files are cut: by the numbers in the names if these rise in both, else by record number.

    A pass over all files gives a sparse index, a row for each split. Pieces
    begin at the splits of the first file; in the second one, reading begins
    at the last indexed record before, up to which records are skipped, and
    ends at the first indexed record behind.
    """
    out, large = {}, []
    for i, (p, m) in enumerate(zip(_files(paths), _files(mates), strict=False)):
        size = max((lambda s, n: s.get_file_info(n).size or 0)(*_open(x)) for x in (p, m))
        if p.endswith(".gz") or m.endswith(".gz") or size <= split:
            continue
        large.append((i, p, m))
    index = _index(spark, [x for _, *both in large for x in both], split) if large else []
    for (i, *_), one, two in zip(large, index[::2], index[1::2], strict=True):
        if not one or not two:
            continue
        by_number = all(r[4] for r in one + two) and all(a[2] < b[1] for x in (one, two) for a, b in zip(x, x[1:]))
        if not by_number and sum(r[3] for r in one) != sum(r[3] for r in two):
            continue  # put in step by one task
        pieces, done, at, starts = [], 0, 0, [0]
        for r in two:
            starts.append(starts[-1] + r[3])
        for j, r in enumerate(one):
            piece = {"start": r[0] if j else 0, "stop": one[j + 1][0] if j + 1 < len(one) else None}
            if by_number:
                while at + 1 < len(two) and two[at + 1][1] <= r[1]:
                    at += 1
                hi = one[j + 1][1] if j + 1 < len(one) else None
                end = next((two[x][0] for x in range(at + 1, len(two)) if hi is not None and two[x][1] >= hi), None)
                piece |= {"mate_start": two[at][0] if j else 0, "mate_stop": end, "lo": r[1] if j else None, "hi": hi}
            else:
                while at + 1 < len(two) and starts[at + 1] <= done:
                    at += 1
                end = next((two[x][0] for x in range(at + 1, len(two)) if starts[x] >= done + r[3]), None)
                piece |= {"mate_start": two[at][0], "mate_stop": end, "skip": done - starts[at], "count": r[3]}
            done += r[3]
            pieces.append(piece)
        out[str(i)] = pieces
    return out


def lines(reads: DataFrame, seq: str = "seq", qua: str = "qua", head: str = "head") -> DataFrame:
    """Four-line records as one text column; the third line is a bare plus."""
    return reads.select(F.concat_ws("\n", head, seq, F.lit("+"), qua).alias("value"))


def write_fastq(reads: DataFrame, path: str, mate_path: str | None = None, mode: str = "append", **options) -> None:
    """Committed FASTQ files; pairs go to two folders in one order (second names from mate_head, else head)."""
    reads.sparkSession.dataSource.register(FastqSource)
    columns = [c for c in ("head", "seq", "qua", *(("mate_head", "mate_seq", "mate_qua") if mate_path else ())) if c in reads.columns]
    w = reads.select(*columns).write.format("fastq").option("path", path).mode(mode)
    if mate_path:
        w = w.option("mate_path", mate_path)
    for k, v in options.items():
        w = w.option(k, str(v))
    w.save()


def write_qualities(reads: DataFrame, path: str, mate_path: str | None = None, mode: str = "append") -> None:
    """The dry-run sink: quality lines only, of both mates if there is a second folder."""
    write_fastq(reads, path, mate_path, mode, kind="qualities")
