"""Personal data, and the terms that give it away, by information content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, body, bucket_of, counted, listed, no_spans, sha, sieve, spans
from .components import connected_components

#: The kinds in their order, in Java's syntax. A run starts at its first character or
#: where the last match ended, and possessive repeats never go back: the same matches as the plain
#: patterns, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
LETTER = r"[\p{L}\p{N}]"
TERM = LETTER + "{4,}"


@dataclass(frozen=True)
class Disclosure:
    """A term t discloses an entity e by PMI(e;t) / IC(e): 1 if every text with t names e.

    An entity is a value, or one of the classes that pool values too rare to be estimated on their
    own: an address's mail domain, an IP address's network, a card's issuer, a number's area,
    and the kind. min_texts: different texts that must hold both, of which those whose terms agree to at
    least `alike` hundredths, as near copies do, are one. Below `short` terms a text is too short to be told from
    another one of its sort, and only equal texts are one. generalise, remove: the two
    thresholds. salts: parts into which the texts of one key are dealt.
    """

    min_texts: int = 3
    alike: int = 80
    short: int = 8
    generalise: float = 0.75
    remove: float = 0.95
    salts: int = 16


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(back.substr(i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _ip(hit: Column) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _card(hit: Column) -> Column:
    return F.when(F.length(_digits(hit)).between(14, 19), _luhn(_digits(hit))).otherwise(False)


def base_spans(text: Column) -> Column:
    """The four kinds, sorted by start and kind."""
    parts = [
        F.when(F.contains(text, F.lit("@")), spans(text, EMAIL, 0, "email")),
        F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), spans(text, IP, 1, "ip", _ip)),
        F.when(text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), spans(text, CARD, 2, "card", _card)),
        F.when(F.contains(text, F.lit("+")), spans(text, PHONE, 3, "phone", lambda h: F.length(_digits(h)).between(10, 15))),
    ]
    return F.array_sort(F.concat(*[F.coalesce(p, no_spans()) for p in parts]))


def _entities(span: Column) -> Column:
    """What a span names: the value, its class, and its kind."""
    plain = F.when(span["kind"] == "email", F.lower(span["hit"])).when(span["kind"] == "ip", span["hit"]).otherwise(_digits(span["hit"]))
    pool = (
        F.when(span["kind"] == "email", F.concat(F.lit("@"), F.substring_index(plain, "@", -1))).when(span["kind"] == "ip", F.concat(F.substring_index(plain, ".", 2), F.lit(".*")))
        .when(span["kind"] == "card", F.concat(F.substring(plain, 1, 6), F.lit("*"))).otherwise(F.concat(F.substring(plain, 1, 4), F.lit("*")))
    )
    return F.array(F.concat_ws(":", span["kind"], plain), F.concat_ws(":", span["kind"], pool), span["kind"])


def terms(text: Column) -> Column:
    """The different terms of a text: lower-case runs of four or more letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


#: Hashes of a text's terms that stand for them where texts are compared; all of them, if there are no more.
SKETCH = 128


def sketch(of: Column) -> Column:
    """The smallest hashes of the terms, sorted. MD5 serves, as other engines have it, too."""
    return F.slice(F.array_sort(F.transform(of, lambda t: F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long"))), 1, SKETCH)


def _bands(hashes: Column) -> Column:
    """array<struct<m,c,x>>: hashes fall into m classes by their remainder, about four to eight of them in each, and
    x is a class's xor; so texts that differ in few terms agree in some class. The next coarser
    division is there as well, for texts at whose size the division changes."""
    n = F.size(hashes)
    m = F.when(n >= 64, 16).when(n >= 32, 8).when(n >= 16, 4).when(n >= 8, 2).otherwise(1)
    of = lambda m, c: F.aggregate(F.filter(hashes, lambda h: h % m == c), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
    level = lambda m: F.transform(F.sequence(F.lit(0), m - 1), lambda c: F.struct(m.cast("int").alias("m"), c.cast("int").alias("c"), of(m, c).alias("x")))
    return F.concat(level(m), F.when(m > 1, level((m / 2).cast("int"))).otherwise(F.array().cast("array<struct<m:int,c:int,x:bigint>>")))


def near_groups(scratch: Scratch, texts: DataFrame, alike: int = 80, short: int = 8) -> DataFrame:
    """(key, grp) for those of texts (key, terms) that are near copies of another: grp is the smallest key of
    the group. Each text meets the smallest key of each band that it shares, never all others of it."""
    own = scratch.save(texts.select("key", sketch(F.col("terms")).alias("hashes")).where(F.size("hashes") >= short))
    bands = own.select("key", F.explode(_bands(F.col("hashes"))).alias("b")).select("key", "b.*")
    first = bands.groupBy("m", "c", "x").agg(F.min("key").alias("other"), F.count("*").alias("n")).where("n > 1")
    tried = bands.join(first, ["m", "c", "x"]).where("key <> other").select("key", "other").distinct()
    both = tried.join(own.withColumnRenamed("hashes", "a"), "key").join(own.select(F.col("key").alias("other"), F.col("hashes").alias("b")), "other")
    least = F.slice(F.array_sort(F.array_union("a", "b")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(least, F.col("a")), F.col("b")))
    edges = scratch.save(both.where(100 * shared >= alike * F.size(least)).select(F.col("key").alias("u"), F.col("other").alias("v")))
    return connected_components(scratch, edges).withColumnsRenamed({"nid": "key", "root": "grp"})


def disclosing_terms(docs: DataFrame, rule: Disclosure = Disclosure(), text_col: str = "text") -> DataFrame:
    """(t, strength): the terms to take out wherever they stand, with the most that each tells of any entity.

    All counts are over all documents, copies included; what carries support is different texts, near
    copies of one counting once, so that a copied text's own words tell nothing.
    Pairs are those that stand in one text: the entities that enough texts name times the text's
    terms. They are counted without a join, so that a common entity meets in no task. A pair can be told only
    if t's documents that name anything are share (n_e / n) ** (1 - generalise) of all that have t, since no more
    of them name e. That leaves out most pairs before they are counted, by two sieves: the greatest share, and
    the least n_e, of what falls into a bucket.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(body(text_col).alias("_t")).withColumn("_s", base_spans(F.col("_t"))).where(F.size("_s") > 0)
    texts = scratch.save(
        named.select(F.md5("_t").alias("key"), F.array_distinct(F.flatten(F.transform("_s", _entities))).alias("entities"), terms(F.col("_t")).alias("terms"))
        .groupBy("key", "entities", "terms").agg(F.count("*").alias("copies"))
    )
    grouped = texts.join(near_groups(scratch, texts, rule.alike, rule.short), "key", "left").withColumn("grp", F.coalesce("grp", "key"))
    grouped = scratch.save(grouped.select("copies", "grp", "terms", "entities"))
    by_entity = grouped.select("copies", "grp", "terms", F.explode("entities").alias("e"))
    entities = scratch.save(by_entity.groupBy("e").agg(F.sum("copies").alias("n_e"), F.count_distinct("grp").alias("texts_e")).where(F.col("texts_e") >= rule.min_texts).select("e", "n_e"))
    held = grouped.select("copies", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("copies").alias("n_held"), F.count("*").alias("texts_t"))
    held = scratch.save(held.where(F.col("texts_t") >= rule.min_texts).select("t", "n_held"))
    every = docs.select(F.explode(terms(body(text_col))).alias("t"))
    often = every.join(sieve(held, "t"), bucket_of(F.col("t")) == F.col("_bucket"), "left_semi").groupBy("t").agg(F.count("*").alias("n_t"))
    often = scratch.save(often.join(held, "t").select("t", "n_t", (F.col("n_held") / F.col("n_t")).alias("share")))
    n = docs.count()
    rare = F.broadcast(entities.groupBy(bucket_of(F.col("e")).alias("_rare")).agg(F.min("n_e").alias("n_least")))
    close = F.broadcast(often.groupBy(bucket_of(F.col("t")).alias("_close")).agg(F.max("share").alias("share")))
    pairs = by_entity.join(rare, bucket_of(F.col("e")) == F.col("_rare")).select("copies", "grp", "e", "n_least", F.explode("terms").alias("t"))
    able = F.col("share") >= F.pow(F.col("n_least") / F.lit(max(n, 1)), F.lit(1 - rule.generalise)) * (1 - 1e-9)
    both = pairs.join(close, bucket_of(F.col("t")) == F.col("_close")).where(able)
    by_group = both.groupBy("e", "t", "grp").agg(F.sum("copies").alias("copies"))
    co = scratch.save(by_group.groupBy("e", "t").agg(F.sum("copies").alias("n_et"), F.count("*").alias("texts_et")).where(F.col("texts_et") >= rule.min_texts).select("e", "t", "n_et"))
    # an entity's pairs are dealt by their terms
    salt = F.pmod(F.xxhash64("t"), F.lit(rule.salts)).cast("int")
    dealt = entities.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rule.salts - 1))))
    size = F.lit(n).cast("long")
    ratio = F.log(size * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log(size / F.col("n_e"))
    told = co.withColumn("salt", salt).join(dealt, ["e", "salt"]).join(often, "t").where(F.col("n_e") < n)
    return told.withColumn("strength", ratio).where(F.col("strength") >= rule.generalise).groupBy("t").agg(F.max("strength").alias("strength"))


def find_pii(docs: DataFrame, rule: Disclosure = Disclosure(), text_col: str = "text") -> DataFrame:
    """docs with `pii`: sorted spans of the four kinds, and of `term` (taken out) and `class`
    (generalised) for terms that disclose an entity, in every text that holds such a term.

    Added spans never overlap the others. Only texts that may hold a telling term are shuffled. A
    null or empty text has no spans; repeated rows get equal spans; a column named `pii` is
    replaced, all others stay, whatever their names; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    rest = docs.drop("pii")
    rows = rest.select(F.struct("*").alias("row"), F.md5(body(text_col)).alias("key"))
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    telling = scratch.save(disclosing_terms(docs, rule, text_col))
    every = rows.select("key", F.explode(terms(text)).alias("w"))
    held = every.join(sieve(telling, "t"), bucket_of(F.col("w")) == F.col("_bucket"), "left_semi").join(telling.withColumnRenamed("t", "w"), "w").groupBy("key", "w").agg(F.max("strength").alias("strength"))
    told = scratch.save(held.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "strength"))).alias("told")))
    flagged = rows.join(sieve(told, "key"), bucket_of(F.col("key")) == F.col("_bucket"), "left")
    plain = flagged.where("_bucket is null").select("row", base_spans(text).alias("pii"))
    salted = flagged.where("_bucket is not null").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(rule.salts)).cast("int"))
    dealt = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rule.salts - 1))))
    based = salted.join(dealt, ["key", "salt"], "left").withColumn("base", base_spans(text))
    strength = lambda s: F.col("told")[F.lower(s["hit"])]
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.transform(
        F.filter(spans(text, TERM, 4, "term"), lambda s: strength(s).isNotNull() & free(s)),
        lambda s: s.withField("kind", F.when(strength(s) >= rule.remove, F.lit("term")).otherwise(F.lit("class"))),
    )
    found = based.select("row", F.when(F.col("told").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", added))).alias("pii"))
    return plain.unionByName(found).select("row.*", "pii")


def sanitise(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The text with entities marked by kind, telling terms removed and weaker ones generalised
    to the sort of word they are. Null and empty texts, and texts without spans, stay as they are; all
    rows and other columns stay."""
    sort = lambda h: F.when(h.rlike("[0-9]"), F.lit("[number]")).when(h.rlike(r"^\p{Lu}"), F.lit("[name]")).otherwise(F.lit("[word]"))
    mark = lambda s: F.when(s["kind"] == "term", F.lit("")).when(s["kind"] == "class", sort(s["hit"])).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    text = F.col(text_col)
    cut = F.aggregate(
        "pii",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(text.substr(a["at"] + 1, s["start"] - a["at"]), mark(s)))).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), text.substr(a["at"] + 1, F.length(text).cast("long"))),
    )
    return found.withColumn(text_col, F.when(F.size("pii") > 0, cut).otherwise(text))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of op3."""
    base = F.filter("pii", lambda s: s["k"] < len(KINDS))
    return found.select(F.col(id_col).alias("doc_id"), *[counted("pii", k) for k in KINDS], sha(listed(base)).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
