"""Importance resampling towards a target's distribution of hashed features."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, body, ranked, small_batches

#: Fixed value: words after A-Z are read as a-z, over UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a text that are held at once.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Resample:
    """width: a feature is a run of 1 to width words. buckets: the features' hash space, which bounds what is
    broadcast and collected of the totals. seed: of the noise. least_words, percent: of the documents with so many
    words, so many hundredths are drawn. head: frequent words, and as many frequent pairs, whose
    hashes are broadcast, none of more than head_bytes; it decides speed, not results."""

    width: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    least_words: int = 20
    percent: int = 10
    head: int = 4096
    head_bytes: int = 64


@dataclass(frozen=True)
class Head:
    """CRC states of frequent words, from which a longer feature goes on, and buckets of frequent pairs."""

    states: dict[bytes, int] = field(default_factory=dict)
    pairs: dict[tuple[bytes, bytes], int] = field(default_factory=dict)


def _blocks(text: bytes, width: int) -> Iterator[list[bytes]]:
    """The words in blocks; each but the first begins with the width - 1 words before it."""
    held: list[bytes] = []
    fresh = 0
    for m in WORD.finditer(text.lower()):  # of bytes, it lower-cases A-Z alone
        held.append(m[0])
        fresh += 1
        if fresh == BLOCK:
            yield held
            held, fresh = held[len(held) - width + 1 :] if width > 1 else [], 0
    if fresh:
        yield held


def bucket_lists(text: bytes, rule: Resample, head: Head) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the features that end in them) of each block of a text.

    A frequent word's state and a frequent pair's bucket are looked up; the hash of anything else is taken
    of its bytes, a longer run's going on from the shorter one's.
    """
    crc, states, pairs, old = zlib.crc32, head.states, head.pairs, 0
    for words in _blocks(text, rule.width):
        now = [states[w] if w in states else crc(w) for w in words]
        got = [np.array(now[old:], dtype=np.int64) % rule.buckets]
        for r in range(2, rule.width + 1):
            # now[i] is the state of the run of r - 1 words that ends in word i + r - 2
            ends = words[r - 1 :]
            now = [crc(w, crc(b" ", s)) for s, w in zip(now, ends)] if r > 2 or not pairs else [crc(w, crc(b" ", s)) if (p := pairs.get((v, w))) is None else p for s, v, w in zip(now, words, ends)]
            got.append(np.array(now[max(0, old - r + 1) :], dtype=np.int64) % rule.buckets)
        yield len(words) - old, np.concatenate(got)
        old = rule.width - 1 if len(words) >= rule.width - 1 else len(words)


def frequent(docs: DataFrame, rule: Resample = Resample(), text_col: str = "text") -> Head:
    """The words, and for wider features the pairs, that stand most often. Each task counts what it reads and
    keeps the most frequent in bounded memory; Spark adds these up. All documents are read."""
    most = rule.head

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"].to_pylist():
                for words in _blocks(text, 2 if rule.width > 1 else 1):
                    seen.update((w, b"") for w in words)
                    if rule.width > 1:
                        seen.update(zip(words, words[1:]))
                    if len(seen) > 32 * most:
                        seen = Counter(dict(seen.most_common(8 * most)))
        found = seen.most_common(2 * most)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.binary()), pa.array([k[1] for k, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["w", "v", "n"])

    small_batches(docs.sparkSession)
    told = docs.select(body(text_col).cast("binary").alias("text")).mapInArrow(count, "w binary, v binary, n long")
    told = told.where(F.octet_length("w") + F.octet_length("v") <= rule.head_bytes).groupBy("w", "v").agg(F.sum("n").alias("n"))
    rows = told.orderBy(F.desc("n"), "w", "v").limit(2 * most if rule.width > 1 else most).collect()
    states, pairs = {}, {}
    for r in rows:
        w, v = bytes(r["w"]), bytes(r["v"])
        if v:
            pairs[w, v] = zlib.crc32(v, zlib.crc32(w + b" "))
        else:
            states[w] = zlib.crc32(w)
    return Head(states, pairs)


def bucket_totals(docs: DataFrame, rule: Resample, head: Head, text_col: str = "text") -> DataFrame:
    """(bucket, n): all features of all documents. A task adds up in an array and gives out a row a bucket."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rule.buckets, dtype=np.int64)
        for b in batches:
            for text in b["text"].to_pylist():
                for _, found in bucket_lists(text, rule, sent.value):
                    total += np.bincount(found, minlength=rule.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    small_batches(docs.sparkSession)
    told = docs.select(body(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return told.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, rule: Resample, head: Head, text_col: str = "text", target_text: str = "text") -> np.ndarray:
    """The gain of each bucket, in thousandths: how much likelier the target's features are than the documents'."""
    s, t = (bucket_totals(df, rule, head, col) for df, col in ((docs, text_col), (target, target_text)))
    space = docs.sparkSession.range(rule.buckets).withColumnRenamed("id", "bucket")
    both = space.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    found = np.zeros((rule.buckets, 2))
    for r in both.collect():  # rule.buckets rows
        found[r["bucket"]] = r["s"], r["t"]
    n = found.sum(axis=0) + rule.buckets
    return np.floor(1000 * np.log((found[:, 1] + 1) * n[0] / ((found[:, 0] + 1) * n[1]))).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, rule: Resample = Resample(), text_col: str = "text", target_text: str = "text") -> DataFrame:
    """docs with `n_words`, `n_features` and `weight`, the floored mean gain of a document's features.

    The documents are read three times, and nothing of theirs is shuffled but counts. A null or empty
    text has no features and weight 0; repeated rows weigh alike; long texts are worked through in
    blocks; without documents there are no rows, and an empty target has all counts 0. Columns of the
    three names are replaced, others stay.
    """
    head = frequent(docs, rule, text_col)
    gains = bucket_gains(docs, target, rule, head, text_col, target_text)
    sent = docs.sparkSession.sparkContext.broadcast((head, gains))

    @F.pandas_udf("n_words long, n_features long, weight long")
    def measured(texts: pd.Series) -> pd.DataFrame:
        own, gain = sent.value
        out = np.zeros((len(texts), 3), dtype=np.int64)
        for i, text in enumerate(texts):
            total = 0
            for n, found in bucket_lists(text, rule, own):
                out[i, :2] += n, len(found)
                total += int(gain[found].sum())
            out[i, 2] = total // int(out[i, 1]) if out[i, 1] else 0
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    rest = docs.drop("n_words", "n_features", "weight")
    return rest.select("*", measured(body(text_col).cast("binary")).alias("_m")).select(*[F.col(f"`{c}`") for c in rest.columns], "_m.*")


def draw(weighed: DataFrame, rule: Resample = Resample(), id_col: str = "doc_id") -> DataFrame:
    """weighed with `score`, the weight with Gumbel noise that the id alone decides, and `rank`, 1, 2, 3 and
    so on for the documents that are drawn: those of the highest scores, ties to the smaller id.

    All rows are ranked by range, none in one task; leave texts out before. Null ids are an
    empty id, after all others in ties; rows of one id have the same noise.
    """
    scratch = Scratch(weighed.sparkSession)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rest = weighed.drop("score", "rank")
    scored = scratch.save(rest.withColumn("score", F.col("weight") + noise).withColumns({"_few": F.col("n_words") < rule.least_words, "_least": -F.col("score")}))
    drawn = scored.where("not _few").count() * rule.percent // 100
    placed = ranked(scratch, scored, [], ["_few", "_least", id_col], "_place")
    return placed.withColumn("rank", F.when(~F.col("_few") & (F.col("_place") <= drawn), F.col("_place"))).drop("_few", "_least", "_place")


def report(drawn: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of op12."""
    return drawn.select(F.col(id_col).alias("doc_id"), "n_features", "weight", "score", "rank")
