"""Transcripts as they grow: a streaming source, and reads of byte ranges that are authenticated."""

from __future__ import annotations

import glob
import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 20
#: Bytes of a file that are read by one task, and digested together once they have been taken.
CHUNK = 64 << 20
LINES = "path string, start long, offset long, `end` long, raw string, n_bytes long, sha256 string, upto string"


class Piece(InputPartition):
    """Bytes [start, end) of a file: the lines whose newline lies there."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _regular(path: str) -> os.stat_result:
    found = os.lstat(path)
    if not stat.S_ISREG(found.st_mode):
        raise ValueError(f"not a regular file: {path}")
    return found


def _open(path: str):
    """A regular file, not a link, and the one that was looked at."""
    before = _regular(path)
    f = os.fdopen(os.open(path, os.O_RDONLY | os.O_NOFOLLOW), "rb")
    now = os.fstat(f.fileno())
    if (now.st_dev, now.st_ino) != (before.st_dev, before.st_ino):
        f.close()
        raise ValueError(f"the file changed while it was opened: {path}")
    return f


def listed(pattern: str) -> dict[str, dict]:
    """{path: size, identity and time of change} of the regular files that match. Nothing is opened."""
    out = {}
    for path in sorted(glob.glob(pattern)):
        try:
            found = _regular(path)
        except (OSError, ValueError):
            continue
        out[path] = {"size": found.st_size, "file": f"{found.st_dev}:{found.st_ino}", "mtime": found.st_mtime_ns}
    return out


def _line_start(f, at: int) -> int:
    """Where the line that holds the byte before `at` begins, if that byte ends no line; else `at`."""
    upto = at
    while upto > 0:
        start = max(0, upto - BLOCK)
        f.seek(start)
        cut = f.read(upto - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        upto = start
    return 0


def lines_in(path: str, start: int, end: int, line_bytes: int) -> Iterator[tuple]:
    """Lines whose newline lies in [start, end): (path, start, offset, end, raw, n_bytes, sha256, upto).

    A line that began before comes whole; one that has not ended yet is left to the read in which it
    does. What is decoded and what is hashed are the same bytes, read once in blocks: sha256 is the
    line's digest, upto that of all bytes from the first line's beginning to this line's end. A line over
    the limit, or one that is no UTF-8, has no raw.
    """
    with _open(path) as f:
        at = first = _line_start(f, start)
        f.seek(at)
        every, line, size, kept = hashlib.sha256(), hashlib.sha256(), 0, []
        offset = at
        while at < end:
            block = f.read(min(BLOCK, end - at))
            if not block:
                raise ValueError(f"the file is shorter than it was: {path}")
            at += len(block)
            for part in _split(block):
                every.update(part)
                body = part.removesuffix(b"\n")
                line.update(body)
                size += len(body)
                if size <= line_bytes:
                    kept.append(body)
                else:
                    kept.clear()
                if part.endswith(b"\n"):
                    try:
                        raw = b"".join(kept).decode() if size <= line_bytes else None
                    except UnicodeDecodeError:
                        raw = None
                    yield path, first, offset, offset + size + 1, raw, size, line.hexdigest(), every.copy().hexdigest()
                    offset += size + 1
                    line, size, kept = hashlib.sha256(), 0, []


def _split(block: bytes) -> Iterator[bytes]:
    """Parts that end in a newline, and what follows the last; other breaks of lines are content."""
    start = 0
    while (cut := block.find(b"\n", start)) >= 0:
        yield block[start : cut + 1]
        start = cut + 1
    if start < len(block):
        yield block[start:]


def _pieces(path: str, start: int, end: int, piece_bytes: int) -> Iterator[tuple[str, int, int]]:
    """Cut at whole multiples of piece_bytes, so that ranges taken in turn fall into the same chunks."""
    while start < end:
        stop = min((start // piece_bytes + 1) * piece_bytes, end)
        yield path, start, stop
        start = stop


#: The most tasks among which the pieces of one read are dealt.
TASKS = 10_000


def read_ranges(ranges: DataFrame, line_bytes: int, piece_bytes: int = CHUNK) -> DataFrame:
    """The lines of byte ranges (path, start, end), read by tasks in pieces. An error fails the job."""
    k = F.explode(F.sequence(F.expr(f"start div {piece_bytes}"), F.expr(f"(`end` - 1) div {piece_bytes}")))
    cut = ranges.where(F.col("start") < F.col("end")).select("path", "start", "end", k.alias("k"))
    rows = cut.select("path", F.greatest(F.col("start"), F.col("k") * piece_bytes).alias("start"), F.least(F.col("end"), (F.col("k") + 1) * piece_bytes).alias("end"))
    todo = rows.repartition(max(1, min(TASKS, rows.count())), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*[b[c].to_pylist() for c in ("path", "start", "end")]):
                held, size = [], 0
                for row in lines_in(path, start, end, line_bytes):
                    held.append(row)
                    size += len(row[4] or "")
                    if size > BLOCK:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    return todo.mapInArrow(read, LINES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = ("path", "start", "offset", "end", "raw", "n_bytes", "sha256", "upto")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


CHECKED = "path string, start long, `end` long, sha256 string, n_bytes long, ok boolean"


def authenticated(known: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, start, end, sha256, n_bytes, ok) of known (path, start, end, sha256): tasks read each range once.

    Ranges that follow one another within a chunk become one, whose digest is taken from the same bytes
    as theirs, so a file that grew in small steps has one digest for each chunk again. n_bytes is what was read.
    A range that does not hold, a file that is gone, shorter or no regular one, is not ok.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None  # path, chunk, start, end, digest, whether all held
        for b in batches:
            out = []
            for path, start, end, want in zip(*[b[c].to_pylist() for c in ("path", "start", "end", "sha256")]):
                if now is None or (path, start // chunk, start) != (now[0], now[1], now[3]):
                    out += [_checked(now)] if now else []
                    if f and now[0] != path:
                        f.close()
                        f = None
                    now = [path, start // chunk, start, start, hashlib.sha256(), True]
                digest, left = hashlib.sha256(), end - start
                try:
                    f = f or _open(path)
                    f.seek(start)
                    while left and (block := f.read(min(BLOCK, left))):
                        digest.update(block)
                        now[4].update(block)
                        left -= len(block)
                except (OSError, ValueError):
                    left = -1
                now[3], now[5] = end, now[5] and not left and digest.hexdigest() == want
            yield _checks(out)
        if f:
            f.close()
        yield _checks([_checked(now)] if now else [])

    by = known.select("path", "start", "end", "sha256").repartition("path", F.expr(f"start div {chunk}")).sortWithinPartitions("path", "start", "end")
    return by.mapInArrow(check, CHECKED)


def _checked(now: list) -> tuple:
    path, _, start, end, digest, ok = now
    return path, start, end, digest.hexdigest(), end - start, ok


def _checks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ("path", "start", "end", "sha256", "n_bytes", "ok")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


class TailReader(DataSourceStreamReader):
    """The offset holds each file's size, identity and time of change. The driver looks at nothing else of a
    file; tasks read what was added. A file that was replaced or cut, or changed without growing, is read
    again from its start. One that was rewritten and grew is noticed by those who authenticate what they
    have read, as follow() and recover() do."""

    def __init__(self, options: dict):
        self.pattern, self.line_bytes = options["path"], int(options.get("lineBytes", 8 << 20))
        self.piece_bytes = int(options.get("pieceBytes", CHUNK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return listed(self.pattern)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for path, to in end.items():
            known = start.get(path, {"size": 0, "file": to["file"]})
            still = known["size"] == to["size"] and known.get("mtime", to["mtime"]) != to["mtime"]
            at = known["size"] if known["file"] == to["file"] and known["size"] <= to["size"] and not still else 0
            pieces += [Piece(*p) for p in _pieces(path, at, to["size"], self.piece_bytes)]
        return pieces

    def read(self, piece: Piece) -> Iterator[tuple]:
        """An error fails the batch, so that its retry reads the same range."""
        for path, start, offset, end, raw, size, digest, upto in lines_in(piece.path, piece.start, piece.end, self.line_bytes):
            yield path, offset, raw, size, digest, start, end, upto

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.readStream.format("tail").option("path", glob)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset long, raw string, n_bytes long, sha256 string, start long, `end` long, upto string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def cursors(known: DataFrame) -> DataFrame:
    """(path, offset): how far each file has been taken."""
    return known.groupBy("path").agg(F.max("end").alias("offset"))
