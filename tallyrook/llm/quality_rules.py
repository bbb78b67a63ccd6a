"""Quality rules: text statistics and robust multivariate outliers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, body, let, words

FEATURES = ("x0", "x1", "x2", "x3", "x4")
#: Features are whole numbers of 1/SCALE, so that their sums do not depend on the order of rows.
SCALE = 1024
D = len(FEATURES)
M, L = [f"m{i}" for i in range(D)], [f"l{i}{j}" for i in range(D) for j in range(i + 1)]


@dataclass(frozen=True)
class Outliers:
    """keep: the share of a group that the minimum covariance determinant covers. steps: the
    concentration steps of each start. cutoff: the largest squared distance that is kept. floor: the
    least standard deviation of each feature, which keeps constant features from a determinant of
    zero. least: rows that a group needs for estimates of its own. consistency: makes the covariance
    of the central `keep` of a normal sample that of the whole (5 features, keep 0.75). blur: what
    the starts add to their correlations' diagonal. salts: parts into which a group's rows are dealt."""

    keep: float = 0.75
    steps: int = 4
    cutoff: float = 60.0
    floor: float = 0.2
    least: int = 50
    consistency: float = 1.412
    blur: float = 0.05
    salts: int = 32


def _repeated(w: Column) -> Column:
    """Words within 5-word windows that occur twice or more in the text.

    Windows are 64-bit hashes. Texts without a repeat, most of them, end after one distinct count;
    for the others equal hashes stand together once sorted, and the places of repeated windows
    cover 5 words each, less what the next one covers again.
    """
    zero = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        nexts = F.concat(F.slice(places, F.lit(2), F.size(places)), F.array(F.element_at(places, -1) + 5))
        return F.aggregate(F.zip_with(places, nexts, lambda p, n: F.least(F.lit(5).cast("long"), n - p)), zero, lambda a, x: a + x)

    def places(s: Column) -> Column:
        return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

    def from_hashes(h: Column) -> Column:
        tagged = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))
        found = let(F.array_sort(tagged), lambda s: let(places(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(found)

    def windows(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - 5), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(5)]))

    return let(w, lambda v: F.when(F.size(v) < 6, zero).otherwise(let(windows(v), from_hashes)))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and
    the features; columns of these names, and _w, _bare, _dup and _lines, are replaced. One pass over whole texts."""
    text = body(text_col)
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    s = docs.withColumns({
        "_w": words(text),
        "_bare": F.length(F.translate(text, " \t\n\u000b\f\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "_dup": F.struct(F.size(full).cast("long").alias("lines"), F.size(F.array_distinct(full)).cast("long").alias("different")),
    })
    s = s.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.col("_bare"),
        "n_dup_lines": F.col("_dup.lines") - F.col("_dup.different"),
        "n_repeat_words": _repeated(F.col("_w")),
        "_lines": F.col("_dup.lines"),
    }).drop("_w", "_bare", "_dup")
    s = s.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    some = F.greatest(F.col("n_words"), F.lit(1))
    raw = (
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / some),
        F.log1p(F.lit(100) * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.lit(4) * F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)),
        F.lit(4) * F.col("n_repeat_words") / some,
    )
    return s.withColumns({x: F.round(v * SCALE).cast("long") for x, v in zip(FEATURES, raw)}).drop("_lines")


def _groups(rows: DataFrame, least: int, lang: str, source: str) -> DataFrame:
    """rows with g: language and source, or the language's small sources together, or all small
    languages together."""
    own = rows.groupBy(lang, source).agg(F.count("*").alias("n"))
    small = own.withColumn("many", F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)).over(Window.partitionBy(lang)))
    tag = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    named = small.withColumn("g", F.when(F.col("n") >= least, F.concat_ws("|", tag(F.col(lang)), tag(F.col(source)))).when(F.col("many") >= least, tag(F.col(lang))).otherwise(F.lit("*")))
    # a row per language and source, dealt like the rows that it meets
    spread = named.select(lang, source, "g").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(31))))
    on = F.col(f"r.{lang}").eqNullSafe(F.col(f"m.{lang}")) & F.col(f"r.{source}").eqNullSafe(F.col(f"m.{source}")) & (F.col("r._part") == F.col("m._part"))
    return rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(32)).cast("int")).alias("r").join(spread.alias("m"), on).select("r.*", "m.g").drop("_part")


def _middle(rows: DataFrame, floor: float) -> DataFrame:
    """(g, m0.., c0..): medians and scaled median deviations, from exact counts of each value.

    A group has at most some 22 000 values of a feature, as these are whole numbers up to SCALE times
    a logarithm or a share, so its counts fit a task at any size.
    """
    counts = rows.select("g", F.posexplode(F.array(*FEATURES)).alias("j", "v")).groupBy("g", "j", "v").agg(F.count("*").alias("n"))

    def median(t: DataFrame, value: str) -> DataFrame:
        by = Window.partitionBy("g", "j")
        run = t.withColumns({"c": F.sum("n").over(by.orderBy(value)), "all": F.sum("n").over(by)})
        return run.where("2 * c >= all").groupBy("g", "j").agg(F.min(value).alias("mid"))

    mid = median(counts, "v")
    away = counts.join(mid, ["g", "j"]).select("g", "j", F.abs(F.col("v") - F.col("mid")).alias("away"), "n")
    both = mid.join(median(away, "away").withColumnRenamed("mid", "mad"), ["g", "j"])
    pick = lambda c, j: F.max(F.when(F.col("j") == j, F.col(c)))
    return both.groupBy("g").agg(
        *[pick("mid", j).cast("double").alias(f"m{j}") for j in range(D)],
        *[F.greatest(pick("mad", j) * 1.4826, F.lit(floor * SCALE)).alias(f"c{j}") for j in range(D)],
    )


def _per_row(rows: DataFrame, table: DataFrame, salts: int) -> DataFrame:
    """rows joined with a table of groups, each group dealt into parts."""
    return rows.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["g", "salt"])


def _factor(frame: DataFrame, cov: Callable[[int, int], Column], least: float) -> DataFrame:
    """frame with l00..: the Cholesky factor of cov."""
    for i in range(D):
        for j in range(i + 1):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            frame = frame.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(least))) if i == j else rest / F.col(f"l{j}{j}"))
    return frame


def _exact(c: Column) -> Column:
    """A sum of whole numbers that no order of rows changes."""
    return F.sum(c.cast("decimal(28,0)")).cast("double")


def _starts(rows: DataFrame, middle: DataFrame, rule: Outliers) -> DataFrame:
    """(g, s, m0.., l00..): three starts of each group around its medians. 0: no correlations. 1:
    those of the deviations z drawn in to z / (1 + |z|). 2: those of the deviations' directions alone."""
    z = [(F.col(f"x{j}") - F.col(f"m{j}")) / F.col(f"c{j}") for j in range(D)]
    length = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    drawn = [F.round(v / (1 + F.abs(v)) * SCALE) for v in z]
    turned = [F.round(F.when(length > 0, v / length).otherwise(0.0) * SCALE) for v in z]
    at = _per_row(rows, middle, rule.salts).select("g", *[v.cast("long").alias(f"{n}{j}") for n, vs in (("a", drawn), ("b", turned)) for j, v in enumerate(vs)])
    sums = at.groupBy("g").agg(F.count("*").cast("double").alias("n"), *[_exact(F.col(f"{n}{i}") * F.col(f"{n}{j}")).alias(f"{n}{i}{j}") for n in "ab" for i in range(D) for j in range(i + 1)])
    both = sums.join(middle, "g")
    out = []
    for s, n in enumerate(("", "a", "b")):
        share = lambda i, j: F.col(f"{n}{i}{j}") / F.col("n") / float(SCALE * SCALE) if n else F.lit(1.0 if i == j else 0.0)  # noqa: B023,E731
        told = _factor(both, lambda i, j: share(i, j) + (rule.blur if i == j else 0.0), rule.blur / 4)  # noqa: B023
        out.append(told.select("g", F.lit(s).alias("s"), *M, *[(F.col(f"l{i}{j}") * F.col(f"c{i}")).alias(f"l{i}{j}") for i in range(D) for j in range(i + 1)]))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _distances(rows: DataFrame, estimates: DataFrame, salts: int) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance, by forward substitution in the Cholesky factor."""
    out = _per_row(rows, estimates, salts)
    for i in range(D):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, D)), F.col("z0") * F.col("z0"))
    return out.withColumn("d2", d2).drop(*M, *L, *[f"z{i}" for i in range(D)])


def _concentrate(scratch: Scratch, rows: DataFrame, estimates: DataFrame, rule: Outliers) -> DataFrame:
    """New estimates of each start from the `keep` of each group that lie nearest by the old ones.

    Distances fall into fixed narrow classes, and the classes up to the one in which the share is
    reached are taken whole: counts of classes are small, exact and the same in every run.
    """
    near = _distances(rows, estimates, rule.salts).withColumn("bin", F.floor(F.log1p("d2") * 256).cast("int"))
    bins = near.groupBy("g", "s", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("g", "s")
    run = bins.withColumns({"c": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    limit = scratch.save(run.where(F.col("c") >= F.ceil(F.col("all") * rule.keep)).groupBy("g", "s").agg(F.min("bin").alias("limit")))
    dealt = limit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rule.salts - 1))))
    kept = near.join(dealt, ["g", "s", "salt"]).where("bin <= limit")
    sums = kept.groupBy("g", "s").agg(
        F.count("*").cast("double").alias("n"),
        *[_exact(F.col(x)).alias(f"s{i}") for i, x in enumerate(FEATURES)],
        *[_exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(D) for j in range(i + 1)],
    )
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(D)})
    ridge = (rule.floor * SCALE) ** 2
    cov = lambda i, j: (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * rule.consistency + (ridge if i == j else 0.0)
    new = scratch.save(_factor(out, cov, ridge / 4).select("g", "s", *M, *L))
    scratch.forget(limit)
    return new


def minimum_determinant(scratch: Scratch, rows: DataFrame, rule: Outliers = Outliers()) -> DataFrame:
    """(g, s, m0.., l00..): each group's center and Cholesky factor of the least determinant that the
    starts reach, and which start it was, the first of equal ones. rows: (g, salt, x0..).

    The covariance has the floor's square on its diagonal, so that it has an inverse whatever the rows.
    """
    estimates = scratch.save(_starts(rows, scratch.save(_middle(rows, rule.floor)), rule))
    for _ in range(rule.steps):
        old, estimates = estimates, _concentrate(scratch, rows, estimates, rule)
        scratch.forget(old)
    det = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, D)), F.log("l00"))
    least = estimates.withColumn("det", det).groupBy("g").agg(F.min_by(F.struct("s", *M, *L), F.struct("det", "s")).alias("e"))
    return scratch.save(least.select("g", "e.*"))


def judge_quality(docs: DataFrame, rule: Outliers = Outliers(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, the statistics, distance, base_failed, kept), one row for each of docs.

    Minimum-covariance-determinant estimates per language and source, by concentration steps from
    three starts; a document that lies further than the cutoff is rejected, as is one that
    fails the base rules. Groups with few rows are estimated together, by language first. A null
    language or source is a group of its own; null and empty texts have zeros and fail the base;
    repeated rows count each; other columns do not matter; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    told = scratch.save(statistics(slim, "_text").drop("_text"))
    rows = scratch.save(_groups(told, rule.least, "_lang", "_source").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(rule.salts)).cast("int")))
    scratch.forget(told)
    # texts without a word say nothing about a group
    estimates = minimum_determinant(scratch, rows.where("n_words > 0").select("g", "salt", *FEATURES), rule)
    left = rows.where("n_words = 0").withColumn("d2", F.lit(None).cast("double"))
    out = _distances(rows.where("n_words > 0"), estimates, rule.salts).drop("s").unionByName(left)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= rule.cutoff)).withColumnRenamed("d2", "distance").drop(*FEATURES, "g", "salt", "_lang", "_source")


def report(judged: DataFrame, columns: Sequence[str] = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) -> DataFrame:
    """The columns of op4."""
    return judged.select(*columns)
