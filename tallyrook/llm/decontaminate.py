"""Benchmark passages in documents, by winnowed fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import free_name
from .common import UPPER, Scratch, body, bucket_of, let, sieve

#: Fixed value: what stands between words, in Java's syntax.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "struct<n_hit:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


@dataclass(frozen=True)
class Winnow:
    """span: words of a window, all of which are found. Half of it are the words of a gram, and the
    grams of a window are those among which the least hash is kept, so a window holds at least
    one kept gram whole. Items of fewer words are one window, and have a level of their own."""

    span: int = 10

    def gram(self, level: int) -> int:
        return (level + 1) // 2


def item_words(text: Column) -> Column:
    """Runs of 0-9, a-z and whatever is not ASCII, A-Z read as a-z."""
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), BETWEEN, -1), "")


def _grams(words: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))


def kept_grams(words: Column, level: int, size: int) -> Column:
    """array<struct<level,h,at>>: of each run of grams within `level` words, the first with the least hash."""
    run = level - size + 1
    least = lambda g: F.transform(F.sequence(F.lit(1), F.size(g) - (run - 1)), lambda i: let(F.slice(g, i, run), lambda x: i + F.array_position(x, F.array_min(x)).cast("int") - 1))
    told = let(_grams(words, size), lambda g: F.transform(F.array_distinct(least(g)), lambda at: F.struct(F.lit(level).alias("level"), F.get(g, at - 1).alias("h"), at.alias("at"))))
    return F.when(F.size(words) >= level, told).otherwise(F.array().cast("array<struct<level:int,h:bigint,at:int>>"))


def item_windows(scratch: Scratch, items: DataFrame, rule: Winnow, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, sets): each different window (level, win) with its least gram h and the mark of the
    set of items that hold it; and (mark, item), each set once. No set is gathered into a row."""
    words = items.select(F.col(id_col).cast("string").alias("item"), item_words(body(text_col)).alias("words")).where((F.size("words") > 0) & F.col("item").isNotNull())
    level = F.least(F.size("words"), F.lit(rule.span))
    each = words.select("item", level.alias("level"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - level + 1), lambda i: F.slice("words", i, level))).alias("w"))
    own = scratch.save(each.select("item", "level", F.array_join("w", " ").alias("win"), "w").distinct())
    size = F.expr("(level + 1) div 2").cast("int")
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.col("level") - size + 1), lambda i: F.xxhash64(F.slice("w", i, size))))
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), F.col("item"))).alias("b"))
    windows = scratch.save(own.groupBy("level", "win").agg(mark.alias("mark"), F.min(least).alias("h")))
    first = windows.groupBy("mark").agg(F.min(F.struct("level", "win")).alias("of")).select("mark", "of.level", "of.win")
    sets = scratch.save(own.join(first, ["level", "win"]).select("mark", "item").distinct())
    return windows, sets


def overlaps(docs: DataFrame, items: DataFrame, rule: Winnow = Winnow(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, overlap) for each different text that holds a window of an item: key is the text's MD5,
    overlap how many of its words are hit, their spans (first and last word, from 0, end exclusive)
    and the items, sorted.

    Each document keeps the grams that win in some run, and those that an item kept as well lead to the
    windows around them, which are compared whole. Only such grams leave a document's task, so the
    shuffle follows the overlap and not the text. Copies of a text are one from the first shuffle on.
    """
    scratch = Scratch(docs.sparkSession)
    windows, sets = item_windows(scratch, items, rule, item_id, item_text)
    levels = sorted(r["level"] for r in windows.select("level").distinct().collect())  # at most rule.span
    grams = scratch.save(windows.select("level", "h").distinct())
    words = docs.select(F.md5(body(text_col)).alias("key"), item_words(body(text_col)).alias("words"))
    picks = F.concat(*[kept_grams(F.col("words"), t, rule.gram(t)) for t in levels]) if levels else F.array().cast("array<struct<level:int,h:bigint,at:int>>")
    told = words.select("key", "words", F.explode(picks).alias("p")).select("key", "words", "p.*")
    met = told.join(sieve(grams, "level", "h"), bucket_of(F.col("level"), F.col("h")) == F.col("_bucket"), "left_semi")
    gram = F.expr("(level + 1) div 2").cast("int")
    first, last = F.greatest(F.lit(1), F.col("at") - F.col("level") + gram), F.least(F.size("words"), F.col("at") + F.col("level") - 1)
    around = met.select("key", "level", "h", first.alias("first"), F.slice("words", first, last - first + 1).alias("near")).join(grams, ["level", "h"], "left_semi")
    at = F.transform(F.sequence(F.lit(0), F.size("near") - F.col("level")), lambda i: F.struct((F.col("first") + i).alias("s"), F.array_join(F.slice("near", i + 1, F.col("level")), " ").alias("win")))
    tried = around.select("key", "level", F.explode(at).alias("x")).select("key", "level", "x.*").distinct()
    hits = scratch.save(tried.join(windows.select("level", "win", "mark"), ["level", "win"]).select("key", (F.col("s") - 1).cast("long").alias("s"), (F.col("s") - 1 + F.col("level")).cast("long").alias("e"), "mark"))

    by = Window.partitionBy("key").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("key", "s", "e").distinct().withColumn("apart", (F.col("s") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("run", F.sum("apart").over(by))
    merged = runs.groupBy("key", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    spans = merged.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    held = hits.select("key", "mark").distinct().join(sets, "mark").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return scratch.save(spans.join(held, "key").select("key", F.struct("n_hit", "spans", "items").cast(FOUND).alias("overlap")))


def find_overlaps(docs: DataFrame, items: DataFrame, rule: Winnow = Winnow(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with `n_words` and `overlap`, which is null where a document shares no window with an item.

    Every shared run of rule.span words is found, however long the text; an item of fewer words counts
    whole. Null texts have no words, an item without an id or without words is no item, and items of one
    text all count. Repeated rows get equal results and all stay; columns named n_words or overlap are
    replaced, and others stay whatever their names; without items nothing is hit, and no documents
    give no rows. Only documents that may be hit are shuffled.
    """
    found = overlaps(docs, items, rule, text_col, item_id, item_text)
    rest = docs.drop("n_words", "overlap")
    key = free_name(rest, "_key")
    bucket = free_name(rest, "_bucket")
    rows = rest.withColumns({"n_words": F.size(item_words(body(text_col))).cast("long"), key: F.md5(body(text_col))})
    flagged = rows.join(sieve(found, "key", name=bucket), bucket_of(F.col(key)) == F.col(bucket), "left")
    clean = flagged.where(F.col(bucket).isNull()).drop(bucket, key).withColumn("overlap", F.lit(None).cast(FOUND))
    met = flagged.where(F.col(bucket).isNotNull()).drop(bucket).join(found.withColumnRenamed("key", key), key, "left").drop(key)
    return clean.unionByName(met)


def decontaminated(found: DataFrame) -> DataFrame:
    """The documents without any overlap, as they were."""
    return found.where("overlap is null").drop("n_words", "overlap")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of op11."""
    items = F.coalesce("overlap.items", F.array().cast("array<string>"))
    return found.select(
        F.col(id_col).alias("doc_id"), "n_words", F.coalesce("overlap.n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col("overlap").isNotNull().alias("contaminated"),
    )
