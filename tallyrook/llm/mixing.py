"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, body, bucket_of, n_words, ranked, row_hash, sieve


def source_targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """(source, source_size, target): share of all sizes by weight, each target at most `most`
    times its source's size.

    Resharing the excess until none is above fills all sources to one level by weight. With the
    sources sorted by size over weight, those that reach their cap come first: the level after
    each prefix of them tells where to stop. One row a source passes through one task.
    """
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "nth": F.row_number().over(filling),
        "all": F.sum("source_size").over(every) * share[0],
        "w_all": F.sum("w").over(every),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "w_capped": F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    # the level if just the sources before this one are at their caps; the first that stays below its own cap sets it
    s = s.withColumn("level", (F.col("all") - share[1] * F.col("capped")) / (share[1] * (F.col("w_all") - F.col("w_capped"))))
    level = F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct("nth", "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * level, F.col("cap").cast("double")))
    return s.withColumn("target", target).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document.

    share: the mix's words as a fraction of all, numerator and denominator. A source's documents
    all expect target / source_size copies, so the prefix sum of expected copies at a document is
    its rank in the source times that rate. One offset in [0, 1) drawn from the seed and the
    source is added, and a document is taken once for each integer crossed: at most `most` times.
    Documents rank by size, then by the md5 of the id, so the sample is even over sizes and the
    words taken come near the target; reruns agree. No source meets in one task. Null texts have
    size 0, null is a source of its own, a source without words has rate 0, repeated rows rank
    one after another, columns of these names are replaced, an empty table stays empty.
    """
    own = ["size", "source_size", "target", "copies"]
    scratch = Scratch(docs.sparkSession)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    slim = scratch.save(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(body(text_col)).alias("size"), F.xxhash64(body(text_col)).alias("_hash"), key.alias("_key")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.save(source_targets(sizes, weights, share, most))
    rank = ranked(scratch, slim, ["source"], ["size", "_key", "_hash"], "_rank")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\u0000")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    r = rank.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.source_size", "t.target")
    r = r.withColumns({"_rate": rate, "_u": offset})
    copies = F.floor(F.col("_rate") * F.col("_rank") + F.col("_u")) - F.floor(F.col("_rate") * (F.col("_rank") - 1) + F.col("_u"))
    return r.withColumn("copies", F.least(copies.cast("long"), F.lit(most).cast("long"))).select("_id", "source", "_hash", "_rank", *own)


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as the mix takes it.

    Rows equal in id, source and text may differ in other columns. They share the copies of their
    group evenly, in the order of a hash of the whole row, so each keeps its own columns and none
    comes more than `most` times. Null ids and sources are values like others, null and empty texts
    have size 0 and come as often as their source's rate says, columns may have any names, an empty
    table stays empty.
    """
    id_col, text_col, source_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    scratch, key = Scratch(docs.sparkSession), ["_id", "source", "_hash"]
    chosen = scratch.save(mix_sources(docs, **options).groupBy(*key).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0"))
    whole = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.xxhash64(body(text_col)).alias("_hash"), row_hash(docs).alias("_order"), F.struct("*").alias("_row")).alias("d")
    on = F.col("d._id").eqNullSafe(F.col("c._id")) & F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d._hash") == F.col("c._hash"))

    def found(part: DataFrame, among: DataFrame = whole) -> DataFrame:
        return among.alias("d").join(part.alias("c"), on).select("d.*", "c._copies", "c._rows")

    # few rows repeat, so the others are left out before the join shuffles whole texts a second time
    repeated = chosen.where("_rows > 1")
    likely = whole.withColumn("_bucket", bucket_of(F.col("_id"), F.col("_hash"))).join(sieve(repeated, "_id", "_hash"), "_bucket").drop("_bucket")
    nth = ranked(scratch, found(repeated, likely), key, ["_order"], "_nth")
    share = (F.col("_nth") * F.col("_copies")).cast("decimal(38,0)"), ((F.col("_nth") - 1) * F.col("_copies")).cast("decimal(38,0)")
    dealt = nth.withColumn("_copies", F.floor(share[0] / F.col("_rows")) - F.floor(share[1] / F.col("_rows")))
    every = found(chosen.where("_rows = 1")).select("_row", "_copies").unionByName(dealt.select("_row", "_copies"))
    return every.where("_copies > 0").select(F.explode(F.array_repeat("_row", F.col("_copies").cast("int"))).alias("_row")).select("_row.*")


def report(mixed: DataFrame) -> DataFrame:
    """The columns of op10."""
    return mixed.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
