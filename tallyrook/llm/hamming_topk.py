"""Exact nearest binary codes by incremental multi-index hashing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class Codes:
    """dims: bits of a code, the signs of so many numbers; longer vectors are an error. seg: bits of a segment, about the
    logarithm of the number of different codes. k: neighbours of each query."""

    dims: int = 64
    seg: int = 16
    k: int = 10

    @property
    def words(self) -> int:
        return -(-self.dims // 64)

    @property
    def segments(self) -> int:
        return -(-self.dims // self.seg)


def sign_code(vector: str, rule: Codes) -> Column:
    """The signs of a vector as 64-bit words; a missing or null number counts as not positive.
    Null for a null vector, an error for one of more numbers than a code has bits."""
    word = lambda w: f"aggregate(sequence(0, 63), 0L, (a, i) -> a | if({w * 64} + i < {rule.dims} and coalesce(get(`{vector}`, {w * 64} + i), 0) > 0, shiftleft(1L, i), 0L))"
    long = f"if(size(`{vector}`) > {rule.dims}, cast(raise_error('a vector is longer than {rule.dims}') as array<bigint>), null)"
    return F.expr(f"if(`{vector}` is null, null, coalesce({long}, array({', '.join(word(w) for w in range(rule.words))})))")


def _segment(code: str, j: int, rule: Codes) -> Column:
    at = j * rule.seg
    return F.shiftrightunsigned(F.get(F.col(code), F.lit(at // 64)), at % 64).bitwiseAND(F.lit((1 << min(rule.seg, rule.dims - at)) - 1)).cast("int")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def _distance(a: str, b: str, rule: Codes) -> Column:
    return sum((_apart(F.get(F.col(a), i), F.get(F.col(b), i)) for i in range(1, rule.words)), _apart(F.get(F.col(a), 0), F.get(F.col(b), 0)))


def nearest_codes(vectors: DataFrame, queries: DataFrame, rule: Codes = Codes(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query, rank, neighbour, distance): for each row of queries its rule.k nearest of vectors by
    Hamming distance of sign codes, ties by id, itself left out.

    Equal codes are one entry with its k + 1 smallest ids, as no more can be asked for. Radius r
    looks up, for each segment, all values at distance r from the query's; a code at distance up
    to segments * (r + 1) - 1 has a segment that near, so a query is done once its kth verified
    distance is no more than that. A code is verified in the round and segment in which it is
    nearest, so once. The radius grows only for queries that are not done.

    A frequent code is one entry, whose members are limited in each partition before they meet; a frequent
    segment's postings are the different codes that share it, and Spark splits such a join by itself.
    Null vectors are neither found nor answered; null ids are found last in ties and asked for as
    any other; fewer rows than k give all there are; repeated rows are rows of their own, of which
    one of the query's id is left out; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession)
    near = rule.k + 1
    code = lambda df: df.select(F.col(id_col).alias("id"), sign_code(vector_col, rule).alias("code")).where("code is not null")
    nth = F.row_number().over(Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last()))
    members = scratch.save(code(vectors).withColumn("nth", nth).where(F.col("nth") <= near))
    index = scratch.save(members.groupBy("code").agg(F.count("*").cast("int").alias("m")))
    asked = scratch.save(code(queries))
    parts = F.array(*[_segment("code", j, rule) for j in range(rule.segments)])
    postings = scratch.save(index.select("code", "m", F.posexplode(parts).alias("j", "v")))
    active = scratch.save(asked.select("code").distinct().withColumn("bound", F.lit(rule.dims)))
    masks = vectors.sparkSession.range(1 << rule.seg).select(F.col("id").cast("int").alias("mask"))
    found = None
    for r in range(rule.seg + 1):
        flips = masks.where(F.bit_count("mask") == r)
        probes = active.select(F.col("code").alias("q"), "bound", F.posexplode(parts).alias("j", "own")).join(F.broadcast(flips), F.lit(True))  # at most 2^seg masks
        probes = probes.select("q", "bound", "j", F.col("own").bitwiseXOR(F.col("mask")).alias("v"))
        lookup = probes.alias("p").join(postings.alias("x"), (F.col("p.j") == F.col("x.j")) & (F.col("p.v") == F.col("x.v")) & (_distance("p.q", "x.code", rule) <= F.col("p.bound")))
        seen = lookup.select("q", F.col("x.code").alias("code"), "m", F.col("p.j").alias("j"), _distance("q", "x.code", rule).alias("d"))
        first = F.lit(True)
        for i in range(rule.segments):
            away = _apart(_segment("q", i, rule), _segment("code", i, rule))
            first &= (away > r) | ((away == r) & (F.col("j") <= i))
        new = seen.where(first).select("q", "code", "m", "d")
        every = new if found is None else found.unionByName(new)
        ahead = F.coalesce(F.sum("m").over(Window.partitionBy("q").orderBy("d").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = scratch.save(every.withColumn("ahead", ahead).where(F.col("ahead") < near).drop("ahead"))
        bounds = found.groupBy("q").agg(F.sum("m").alias("n"), F.max("d").alias("kth")).where(F.col("n") >= near)
        left = active.select("code").join(bounds.withColumnRenamed("q", "code"), "code", "left")
        active = scratch.save(left.where(F.col("kth").isNull() | (F.col("kth") > rule.segments * (r + 1) - 1)).select("code", F.coalesce("kth", F.lit(rule.dims)).alias("bound")))
        if active.isEmpty():
            break
    hits = found.alias("f").join(members.alias("m"), F.col("f.code") == F.col("m.code")).select("f.q", "f.d", F.col("m.id").alias("neighbour"), "m.nth")
    by = Window.partitionBy("q").orderBy("d", F.col("neighbour").asc_nulls_last(), "nth")
    best = scratch.save(hits.withColumn("n", F.row_number().over(by)).where(F.col("n") <= near).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "d", "neighbour"))).alias("best")))
    answers = asked.alias("a").join(best.alias("b"), F.col("a.code") == F.col("b.q")).select(F.col("a.id").alias("query"), "best")
    own = F.array_min(F.transform(F.filter("best", lambda x: x["neighbour"].eqNullSafe(F.col("query")) & (x["d"] == 0)), lambda x: x["n"]))
    others = answers.withColumn("own", own).withColumn("best", F.filter("best", lambda x: F.col("own").isNull() | (x["n"] != F.col("own"))))
    return others.select("query", F.posexplode(F.slice("best", 1, rule.k)).alias("rank", "b")).select("query", (F.col("rank") + 1).alias("rank"), F.col("b.neighbour").alias("neighbour"), F.col("b.d").alias("distance"))


def report(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("query").alias("vec_id"), "rank", "neighbour", "distance")
