"""Shared native column helpers and durable intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACES = " \t\n\u000b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHUNK = 1024


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lowers the session's limit of bytes in an Arrow batch, where it is larger, to 4 MB or one row.

    Spark's own limit is 64 MB, which the JVM and each Python worker hold several times.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, most)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system. Workers outlive their
    tasks, and what they keep counts beside the executor's heap in later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Buckets of a sieve: what it broadcasts has at most so many rows, whatever the data.
SIEVE = 1 << 18


def bucket_of(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(SIEVE)).cast("int")


def sieve(wanted: DataFrame, *columns: str, name: str = "_bucket") -> DataFrame:
    """The buckets of wanted's values, to be broadcast: a row whose bucket is not among them matches
    none. It thins out what an exact join or count must shuffle, and decides nothing."""
    return F.broadcast(wanted.select(bucket_of(*[F.col(c) for c in columns]).alias(name)).distinct())


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, maps and variants apart, by which repeated rows can be told and ordered."""
    plain = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def body(name: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+", -1), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Binds a value to a lambda's variable, so that each row computes it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(steps: Column) -> Column:
    """Running sums of an array of long. Done in chunks, so that the copying for n elements
    stays near n * CHUNK rather than n squared."""
    longs = F.array().cast("array<bigint>")

    def within(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).cast("long").alias("t"), longs.alias("o")),
            lambda a, x: F.struct((a["t"] + x).alias("t"), F.array_append(a["o"], a["t"] + x).alias("o")),
            lambda a: a["o"],
        )

    def offsets(parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.struct(F.lit(0).cast("long").alias("t"), longs.alias("o")),
            lambda a, p: F.struct((a["t"] + F.element_at(p, -1)).alias("t"), F.array_append(a["o"], a["t"]).alias("o")),
            lambda a: a["o"],
        )

    def chunked(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(s), F.lit(CHUNK)), lambda i: within(F.slice(s, i, CHUNK)))
        return let(parts, lambda p: F.flatten(F.zip_with(p, offsets(p), lambda c, o: F.transform(c, lambda x: x + o))))

    return let(steps, lambda s: F.when(F.size(s) == 0, longs).when(F.size(s) <= CHUNK, within(s)).otherwise(chunked(s)))


def spans(text: Column, pattern: str | Column, order: int, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """The leftmost non-overlapping matches as array<struct<start,k,end,kind,hit>>, in code points.

    The pieces between the matches and the matches themselves give every place by running sums,
    with the regular expressions that the JVM has. pattern may be each row's own. keep drops matches by their text.
    """
    each = F.lit(pattern) if isinstance(pattern, str) else pattern

    def place(pieces: Column, hits: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: (F.length(p) + F.length(h)).cast("long"))
        return F.zip_with(
            running(steps),
            hits,
            lambda e, h: F.struct((e - F.length(h)).alias("start"), F.lit(order).alias("k"), e.alias("end"), F.lit(kind).alias("kind"), h.alias("hit")),
        )

    found = let(F.regexp_extract_all(text, each, F.lit(0)), lambda hits: place(F.split(text, each, -1), hits))
    return F.filter(found, lambda s: keep(s["hit"])) if keep else found


NO_SPANS = "array<struct<start:bigint,k:int,end:bigint,kind:string,hit:string>>"


def no_spans() -> Column:
    return F.array().cast(NO_SPANS)


def listed(found: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(found: str, kind: str) -> Column:
    """n_kind: how many spans are of a kind."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def ranked(scratch: Scratch, df: DataFrame, group: list[str], order: list[str], name: str = "rank", total: str | None = None) -> DataFrame:
    """row_number() from 1 over group by order, with no group in one task; with total, also the
    running sum of that column as {total}_upto.

    Rows are dealt by range of (group, order), numbered within each range, and shifted by the
    rows that earlier ranges hold of the group. The counts are one row a range and group.
    Ties are broken by a row number of the stored table, so a tie of equal rows is harmless.
    """
    keys = [*group, *order]
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = scratch.save(
        df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *[F.col(k).asc_nulls_last() for k in keys], "_tie").withColumn("_part", F.spark_partition_id())
    )
    sums = {"_n": F.count("*")} | ({"_t": F.sum(total)} if total else {})
    counts = at.groupBy("_part", *group).agg(*[v.alias(k) for k, v in sums.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_part", *group, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_shift") for k in sums])
    inside = Window.partitionBy("_part", *group).orderBy(*[F.col(k).asc_nulls_last() for k in order], "_tie")
    own = {"_rn": F.row_number().over(inside)} | ({"_sum": F.sum(total).over(inside.rowsBetween(Window.unboundedPreceding, 0))} if total else {})
    on = F.col("a._part") == F.col("b._part")
    for g in group:
        on &= F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    out = at.withColumns(own).alias("a").join(shift.alias("b"), on)
    more = [(F.col("a._sum") + F.col("b._t_shift")).cast("long").alias(f"{total}_upto")] if total else []
    return out.select("a.*", (F.col("a._rn") + F.col("b._n_shift")).cast("long").alias(name), *more).drop("_part", "_rn", "_sum", "_tie")
