"""Similarity join on word n-grams with token-combination prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, Scratch, body, bucket_of, row_hash, sieve, small_batches, words
from .components import connected_components


@dataclass(frozen=True)
class Join:
    """Sets of `width`-word shingles link when num/den of their union is shared.

    classes: (least count, k, groups) for each class of frequent tokens, which are indexed by
    combinations of k within each of so many groups; k = 1 just puts them behind rarer ones. frequent: tokens that may be so classed, the
    most frequent first; the table is broadcast, and tokens beyond it are indexed singly.
    single_from: sets of more shingles than this index single tokens, as their combinations would
    be many; sets near it index both ways. stars: rounds that test one member of each list
    before the rest are tested in full. send: rows of ids that may be broadcast. length, cuts: a
    list of more than `length` members, or of more than a `cuts`th of all entries, is dealt into parts of that
    length; so there are at most `cuts` such lists, whatever the data.
    """

    width: int = 3
    num: int = 90
    den: int = 100
    classes: tuple[tuple[int, int, int], ...] = ((2, 1, 1), (8, 1, 1), (32, 2, 8), (4096, 3, 32))
    frequent: int = 200_000
    single_from: int = 1_500
    stars: int = 2
    send: int = 500_000
    length: int = 500
    cuts: int = 100_000


#: Bits of every set, and of sets from WIDE_FROM shingles on.
BITS, WIDE, WIDE_FROM = 512, 8192, 900
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _shingles(w: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles of the hashes of a text's words. Fewer words make one."""
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(width, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * _ODD[0] + w[i : n - k + 1 + i] * _ODD[1 + i % 4] + np.uint64(i))
    return np.unique(h)


def _word_hashes(text: Column) -> Column:
    return F.transform(words(F.translate(text, UPPER, UPPER.lower())), lambda w: F.xxhash64(w))


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = column.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:]):
        yield flat[a:b]


def _need(n: int, rule: Join) -> int:
    """Tokens of a set of n, one more than those that a partner may lack."""
    return n - -(-rule.num * n // rule.den) + 1


class Indexer:
    """The index entries of a set. All sets order their tokens by (class, hash).

    A prefix is extended until, for each way in which a partner lacks as many tokens as it may,
    it still shares k tokens of one group: a group of c tokens in the prefix withstands c - k + 1
    losses less one. Sets whose tokens end before that index single tokens as well. Of two linked
    sets, take the one whose prefix ends first: the other's holds all that they share of it, so
    they share an entry, unless both end early, and then they share a single token.
    """

    def __init__(self, rule: Join, tokens: np.ndarray, classes: np.ndarray):
        self.rule, self.tokens, self.classes = rule, tokens, classes

    def class_of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(s), np.int8)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.classes[at], 0).astype(np.int8)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        rule, n = self.rule, len(s)
        if not n:
            return s
        need, kind = _need(n, rule), self.class_of(s)
        first = np.argsort(kind, kind="stable")
        s, kind = s[first], kind[first]
        singles = lambda tag: _mix(s[:need] + np.uint64(tag))
        out = []
        if n * rule.den >= rule.single_from * rule.num:
            out.append(singles(1))
        if n <= rule.single_from:
            plain = min(need, int(np.searchsorted(kind, 1)))
            out.append(_mix(s[:plain] + np.uint64(2)))
            left = need - plain
            if left:
                groups: dict[tuple[int, int], list[np.uint64]] = {}
                for t, c in zip(s[plain:], kind[plain:]):
                    _, k, parts = rule.classes[c - 1]
                    g = groups.setdefault((int(c), int(t % np.uint64(parts))), [])
                    g.append(t)
                    left -= len(g) >= k
                    if not left:
                        break
                for (c, _), g in groups.items():
                    k = rule.classes[c - 1][1]
                    if len(g) >= k:
                        both = np.array(list(combinations(g, k)), np.uint64)
                        h = np.full(len(both), 2 + k, np.uint64)
                        for i in range(k):
                            h = _mix(h * _ODD[0] + both[:, i])
                        out.append(h)
                if left:
                    out.append(singles(3))
        return np.unique(np.concatenate(out))


def _bits(s: np.ndarray, bits: int) -> np.ndarray:
    """The parity of tokens by hash, as 64-bit words: two sets differ in at least as many tokens as bits."""
    odd = (np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _long_lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *[a.view(np.int64) for a in arrays]])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _frequent(scratch: Scratch, hashed: DataFrame, rule: Join) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, classes), sorted: tokens by the number of sets that hold them in a plain prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [s[: _need(len(s), rule)] for s in (_shingles(w, rule.width) for w in _lists(b.column(0))) if len(s)]
            t, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], ["t", "n"])

    counts = hashed.select("w").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= rule.classes[0][0]).orderBy(F.desc("n"), "t").limit(rule.frequent).toArrow()
    t = top["t"].to_numpy().view(np.uint64)
    c = np.searchsorted([least for least, _, _ in rule.classes], top["n"].to_numpy(), side="right").astype(np.int8)
    order = np.argsort(t)
    return t[order], c[order]


def _index(hashed: DataFrame, indexer: Indexer, rule: Join) -> DataFrame:
    """(_id, n, node, sigs, bits, wide): node is the md5 of the sorted set; small sets have no wide."""
    schema = T.StructType([hashed.schema["_id"], T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("sigs", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("wide", T.ArrayType(T.LongType()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingles(w, rule.width) for w in _lists(b.column(1))]
            node = pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary())
            n = pa.array([len(s) for s in sets], pa.int64())
            wide = [_bits(s, WIDE) if len(s) >= WIDE_FROM else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), n, node, _long_lists([indexer(s) for s in sets]), _long_lists([_bits(s, BITS) for s in sets]), _long_lists(wide)], schema.names)

    return hashed.select("_id", "w").mapInArrow(index, schema)


def _sets(docs: DataFrame, wanted: DataFrame, rule: Join) -> DataFrame:
    """(nid, s): the shingles of wanted (nid, rep, node), from one text each."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingles(w, rule.width) for w in _lists(b.column(0))]
            right = pa.array([hashlib.md5(s.tobytes()).digest() == bytes(m) for s, m in zip(sets, b.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(2), _long_lists(sets)], ["nid", "s"]).filter(right)

    few = wanted.count() <= rule.send
    side = F.broadcast(wanted) if few else wanted
    found = docs.join(side, F.col("_id").eqNullSafe(F.col("rep"))).select(_word_hashes(F.col("_text")).alias("w"), "node", "nid")
    return found.mapInArrow(fetch, "nid long, s array<long>").dropDuplicates(["nid"])


def _near(a: str, b: str, rule: Join) -> Column:
    """What two linked sets must pass: sizes in proportion, and few enough odd bits that differ."""
    na, nb, x, y = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.bits"), F.col(f"{b}.bits")
    odd = sum((F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(1, BITS // 64)), F.bit_count(F.get(x, 0).bitwiseXOR(F.get(y, 0))))
    return (F.least(na, nb) * rule.den >= F.greatest(na, nb) * rule.num) & (odd * (rule.den + rule.num) <= (na + nb) * (rule.den - rule.num))


def _with_ends(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with those columns of a's node as x and of b's as y."""
    end = lambda k, s: nodes.select(F.col("nid").alias(k), F.struct("n", *columns).alias(s))
    return pairs.join(end("a", "x"), "a").join(end("b", "y"), "b")


def _still_near(pairs: DataFrame, nodes: DataFrame, rule: Join) -> DataFrame:
    """The pairs that pass the wide bits too, where both have them."""
    far = F.aggregate(F.zip_with("x.wide", "y.wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = far * (rule.den + rule.num) <= (F.col("x.n") + F.col("y.n")) * (rule.den - rule.num)
    return _with_ends(pairs, nodes, "wide").where(F.when((F.size("x.wide") > 0) & (F.size("y.wide") > 0), close).otherwise(True)).select("a", "b")


def _verified(scratch: Scratch, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, rule: Join) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    pairs = scratch.save(_still_near(pairs, nodes, rule))
    ends = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).distinct()
    wanted = scratch.save(nodes.join(ends, "nid").select("nid", "rep", "node"))
    sets = scratch.save(_sets(docs, wanted, rule))
    both = pairs.join(sets.select(F.col("nid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("nid").alias("b"), F.col("s").alias("sb")), "b")
    shared = both.select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"))
    linked = scratch.save(shared.where(F.col("i") * rule.den >= (F.col("na") + F.col("nb") - F.col("i")) * rule.num).select("a", "b"))
    scratch.forget(pairs, wanted, sets)
    return linked


def _in_parts(lists: DataFrame) -> DataFrame:
    """A row for each part of the lists (sig, parts)."""
    return lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _lists_of(nodes: DataFrame, rule: Join) -> DataFrame:
    """(sig, part, parts, nid): the lists that have several members. Long ones are dealt into parts by a
    hash of the member, and are told without a join on what they share."""
    posts = nodes.select("nid", F.explode("sigs").alias("sig"))
    total = nodes.agg(F.coalesce(F.sum(F.size("sigs")), F.lit(0))).first()[0]
    longest = max(rule.length, total // rule.cuts)
    sizes = posts.groupBy("sig").agg(F.count("*").alias("m"))
    long = sizes.where(F.col("m") > longest).select("sig", F.ceil(F.col("m") / longest).cast("int").alias("parts"))  # at most rule.cuts rows
    tagged = posts.join(F.broadcast(long), "sig", "left")
    cut = tagged.where("parts is not null").select("sig", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int").alias("part"), "parts", "nid")
    shared = sizes.where((F.col("m") > 1) & (F.col("m") <= longest)).select("sig")
    plain = tagged.where("parts is null").join(shared, "sig").select("sig", F.lit(0).alias("part"), F.lit(1).alias("parts"), "nid")
    return cut.unionByName(plain)


def jaccard_groups(docs: DataFrame, rule: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_shingles, component_id), one row for each of docs.

    Equal sets are one node. Nodes that share an index entry stand in a list. First one member of
    each list is tested against the others and leaves it, which joins most of a group of near copies;
    then, in the lists that still hold several components, all pairs across components with one
    end outside the list's largest component. So every link either was tested or lies within one component, and a
    list of near copies costs its length rather than its square.

    Null, empty and blank texts have no shingles and are components of their own, whatever they share; a
    component's id is the smallest id of its documents, null if all are null; repeated rows are
    one node; other columns do not matter; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("_text"))
    hashed = slim.select("_id", _word_hashes(F.col("_text")).alias("w"))
    indexer = Indexer(rule, *_frequent(scratch, hashed, rule))
    indexed = scratch.save(_index(hashed, indexer, rule))
    same = indexed.where("node is not null").groupBy("node").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("sigs").alias("sigs"), F.first("bits").alias("bits"), F.first("wide").alias("wide"))
    nodes = scratch.save(same.withColumn("nid", F.monotonically_increasing_id()))
    rows = scratch.save(indexed.select("_id", "n", "node"))
    scratch.forget(indexed)
    lists = scratch.save(_lists_of(nodes, rule))
    labels = None  # (nid, root) of linked nodes

    def placed(at: DataFrame) -> DataFrame:
        """Rows of lists, saved, with their component, of the lists that hold several. The rows before go."""
        if labels is None:
            out = scratch.save(at.withColumn("root", F.col("nid")))
            scratch.forget(at)
            return out
        named = scratch.save(at.select("sig", "part", "parts", "nid").join(labels, "nid", "left").withColumn("root", F.coalesce("root", "nid")))
        scratch.forget(at)
        open_ = named.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("parts").alias("parts")).where("lo < hi")
        out = scratch.save(named.join(_in_parts(open_.select("sig", "parts")).drop("parts"), ["sig", "part"]))
        scratch.forget(named)
        return out

    def joined(links: DataFrame) -> DataFrame:
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if labels is not None:
            edges = edges.union(labels.where("nid <> root").select(F.col("nid").alias("u"), F.col("root").alias("v")))
        out = connected_components(scratch, edges)
        scratch.forget(links, *([] if labels is None else [labels]))
        return out

    for r in range(rule.stars):
        at = placed(lists)
        pivot = at.groupBy("sig").agg(F.min_by(F.struct("nid", "root"), F.xxhash64("sig", "nid", F.lit(r))).alias("p"), F.max("parts").alias("parts"))
        # the member that is tested against all others has done its part
        lists = scratch.save(at.join(_in_parts(pivot).drop("parts"), ["sig", "part"]).where("nid <> p.nid"))
        scratch.forget(at)
        pairs = lists.where("root <> p.root").select(F.least("nid", "p.nid").alias("a"), F.greatest("nid", "p.nid").alias("b")).distinct()
        near = _with_ends(pairs, nodes, "bits").where(_near("x", "y", rule)).select("a", "b")
        labels = joined(_verified(scratch, slim, nodes, near, rule))

    at = placed(lists)
    sizes = at.groupBy("sig", "root").agg(F.count("*").alias("m"), F.max("parts").alias("parts"))
    main = sizes.groupBy("sig").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.max("parts").alias("parts"))
    told = scratch.save(at.join(_in_parts(main).drop("parts"), ["sig", "part"]).join(nodes.select("nid", "n", "bits"), "nid"))
    scratch.forget(at)
    # each member outside the largest component meets every part of its list
    few, every = _in_parts(told.where("root <> main").drop("part")).alias("x"), told.alias("y")
    across = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.nid") < F.col("y.nid")))
    rest = few.join(every, across & _near("x", "y", rule)).select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct()
    linked = _verified(scratch, slim, nodes, rest, rule)
    scratch.forget(told)
    labels = joined(linked)

    home = nodes.select("node", "nid", "rep").join(labels, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    ids = home.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.save(home.join(ids, "root").select("node", "component_id"))
    scratch.forget(nodes, labels)
    out = rows.select("_id", "n", "node").alias("r").join(named.alias("c"), F.col("r.node") == F.col("c.node"), "left")
    own = F.when(F.col("r.node").isNull(), F.col("r._id")).otherwise(F.col("c.component_id"))
    return out.select("r._id", F.col("r.n").alias("n_shingles"), own.alias("component_id"))


def keep_first(docs: DataFrame, rule: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each group: the one of the smallest id stays, and one
    of rows that repeat id and text, the least by a hash of the whole row. Documents without an id stay
    only if no document with an id is in their group, one for each different text; null and empty
    texts have no group and stay. Columns may have any names; an empty table stays empty."""
    scratch = Scratch(docs.sparkSession)
    groups = scratch.save(jaccard_groups(docs, rule, id_col, text_col).select("_id", "component_id"))
    # written, so that its size is known before texts would be shuffled to meet it
    first = scratch.save(groups.where(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("_id").agg(F.count("*").alias("copies")))
    whole = docs.select(F.col(id_col).alias("_id"), F.md5(body(text_col)).alias("text"), row_hash(docs).alias("order"), F.struct("*").alias("row"))

    def found(among: DataFrame, part: DataFrame) -> DataFrame:
        return among.alias("d").join(part.alias("f"), F.col("d._id").eqNullSafe(F.col("f._id"))).select("d.*")

    repeated = first.where("copies > 1")
    likely = whole.withColumn("_bucket", bucket_of(F.col("_id"))).join(sieve(repeated, "_id"), "_bucket").drop("_bucket")
    again = found(likely, repeated).groupBy("_id", "text").agg(F.min_by("row", "order").alias("row"))
    return found(whole, first.where("copies = 1")).select("row").unionByName(again.select("row")).select("row.*")


def report(groups: DataFrame) -> DataFrame:
    """The columns of op5."""
    return groups.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")
