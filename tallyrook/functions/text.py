"""Column functions: digests, byte limits, redaction, versions and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import REDACTION


def digest(c: Column) -> Column:
    """SHA-256 of a string or of bytes, in hex."""
    return F.sha2(c, 256)


def prefix_digest(c: Column, n: Column | int) -> Column:
    """SHA-256 of the first n bytes."""
    raw = c.cast("binary")
    return F.sha2(F.substring(raw, F.lit(1), n if isinstance(n, Column) else F.lit(n)), 256)


def truncate_bytes(c: Column, limit: int, mark: str) -> Column:
    """At most limit bytes of UTF-8: a longer text is cut at a character's end, with a mark that fits within the limit."""
    room = limit - len(mark.encode())
    if room < 0:
        raise ValueError("the mark is longer than the limit")
    raw = c.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, room - i).cast("string")) for i in range(4) if room - i >= 0]
    return F.when(c.isNull() | (F.octet_length(c) <= limit), c).otherwise(F.concat(F.coalesce(*cuts, F.lit("")), F.lit(mark)))


def redact(c: Column, rules: Sequence[tuple[str, str]] = REDACTION) -> Column:
    """Applies (pattern, replacement) rules in turn."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def version_at_least(c: Column, floor: str) -> Column:
    """Whether a stable version a.b.c reaches the floor. Pre-releases and anything else do not."""
    least = F.array(*[F.lit(int(x)) for x in floor.split(".")])
    parts = F.transform(F.split(c, r"\."), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))
    return F.coalesce(F.when(c.rlike(r"^[0-9]{1,9}\.[0-9]{1,9}\.[0-9]{1,9}$"), parts >= least), F.lit(False))


def canonical(path: Column) -> Column:
    """An absolute path without `.`, `..`, repeated or trailing slashes; the root itself is /. A drive's
    letter is lower case and its backslashes are slashes. Null for a path that is not absolute.

    Its parts are folded onto a stack. Links are not followed, as a path in a log has no file system.
    """
    drive = path.rlike(r"^[A-Za-z]:[\\/]")
    plain = F.when(drive, F.concat(F.lit("/"), F.lower(F.substring(path, 1, 2)), F.translate(F.substring(path, 3, 1 << 20), "\\", "/"))).otherwise(path)
    none = F.array().cast("array<string>")
    step = lambda stack, part: F.when(part.isin("", "."), stack).when(part == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.array_append(stack, part))
    folded = F.aggregate(F.split(plain, "/", -1), none, step)
    return F.when(plain.startswith("/"), F.concat(F.lit("/"), F.array_join(folded, "/")))


def within(path: Column, root: Column) -> Column:
    """Whether an absolute path is the root or lies below it, both read in their canonical form; false for others."""
    here, base = canonical(path), canonical(root)
    return F.coalesce((here == base) | here.startswith(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))), F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    while name in df.columns:
        name += "_"
    return name


def row_digest(df: DataFrame) -> Column:
    """A hash of 64 bits of the whole row, by which rows that are equal can be told and ordered. Maps and variants, which Spark
    does not hash, are read as JSON."""
    own = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    odd = lambda f: any(k in f.dataType.simpleString() for k in ("map<", "variant"))
    return F.xxhash64(F.lit(0), *[F.to_json(F.struct(own(f))) if odd(f) else own(f) for f in df.schema.fields])


def native_id() -> Column:
    """The event's own id: prompt_id, else turn_id, else session and time."""
    return F.coalesce("prompt_id", "turn_id", F.concat_ws("/", "session_id", F.col("ts").cast("string")))
