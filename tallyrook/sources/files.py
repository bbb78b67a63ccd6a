"""Batch readers and writers of the collected files."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.schema import Contract, Field
from ..functions.scratch import Scratch, read_or_empty
from ..operators.filters import EVENT, accepted, judge_lines, quarantined
from ..operators.matching import differing, isolate, multiset_digest, new_events
from ..policy import EVENT_FIELDS, Policy, check_name

#: How a published line is written: the same text whatever the session's time zone is.
JSON = {"ignoreNullFields": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of JSONL files. A file may be split among tasks."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def read_pending(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw) of the queue: one event in each file."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of a SHA256SUMS file; lines of another shape are left out."""
    line = spark.read.text(path).select(F.regexp_extract("value", r"^([0-9a-f]{64}) [ *](.+)$", 1).alias("sha256"), F.regexp_extract("value", r"^([0-9a-f]{64}) [ *](.+)$", 2).alias("path"))
    return line.where("sha256 <> ''").select("path", "sha256")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_policy(spark: SparkSession, path: str) -> Policy:
    """The configuration, a small file, validated strictly."""
    return Policy.from_json(spark.read.text(path, wholetext=True).first()[0])


def read_registry(spark: SparkSession, path: str, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(events, evidence) of the public registry, strictly: lines with any other field, without a
    needed one, of a wrong type or malformed are left out, and only their digest is kept. What is missing then comes
    back when the registry is rebuilt from the private store."""
    lines = spark.read.text(f"{path}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    published = Contract(tuple(Field(f.name, f.kind, f.name in ("event_id", "tool", "prompt")) for f in EVENT.fields))
    judged = judge_lines(lines, policy, published)
    return accepted(judged, published), quarantined(judged)


def append_store(events: DataFrame, path: str, origin: str = "direct") -> None:
    """Appends to the private store; the commit protocol makes the files durable together. origin tells
    direct captures from recovered ones."""
    if origin not in ("direct", "recovered"):
        raise ValueError(f"not an origin: {origin}")
    events.withColumn("origin", F.lit(origin)).write.mode("append").parquet(path)


def published_lines(private: DataFrame) -> DataFrame:
    """private's published fields with `user` and `line`, the JSON that stands for a row in the registry."""
    kept = [c for c in EVENT_FIELDS if c in private.columns]
    return private.select(*kept, F.col("identity").alias("user"), F.to_json(F.struct(*kept), JSON).alias("line"))


def _files_of(spark: SparkSession, path: str, names: list[str]) -> list:
    """The registry's files of these users, hidden ones included, and the file system."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    at = [jvm.Path(f"{path}/user={name}") for name in names]
    return fs, [f.getPath() for folder in at if fs.exists(folder) for f in fs.listStatus(folder)]


def rebuild_registry(private: DataFrame, path: str, users: int = 10_000, isolated: str | None = None, health: str | None = None, file_bytes: int = 256 << 20) -> list[str]:
    """Makes the public registry equal to the private store, a folder for each user, and returns the users it wrote.

    Both sides of a user become one digest that no order changes (`matching.multiset_digest`), and only users whose
    digests differ are written; all others' files stay as they are. New files are added before old ones are
    deleted, so a reader may for a while find a user's events twice, but never miss them, and after a crash in
    between the digest differs and the user is written again. Of several contents under one id the first by time is published.

    isolated: where evidence of what isn't published is appended: an id's other contents (collision), rows
    without a tool, an id or a user (null), and lines that stood in the registry but not in the store (modified). It
    holds up nothing else. health: where codes go. A user's events are dealt over files of about file_bytes
    by a hash of their ids, so none is whole in one task, and each file is in the order of time. Users are
    folders, so their names must be plain, and there can be only so many. An empty store empties the registry.
    """
    spark, path, scratch = private.sparkSession, path.rstrip("/"), Scratch(private.sparkSession)
    try:
        rows = published_lines(private)
        whole = rows.where("tool is not null and event_id is not null and user is not null")
        kept, others = isolate(whole, ["tool", "event_id"], "line", order=[F.col("ts").asc_nulls_last()], scratch=scratch)
        try:
            public = spark.read.schema("value string, user string").text(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            public = spark.createDataFrame([], "value string, user string")
        want, have = scratch.save(multiset_digest(kept, ["user"], "line")), multiset_digest(public, ["user"], "value")
        differ = scratch.save(differing(want, have, "user"))
        names = [r["user"] for r in differ.select("user").limit(users + 1).collect()]
        if len(names) > users or want.count() > users:
            raise ValueError(f"more than {users} users")
        for name in names:
            check_name(name)
        fs, old = _files_of(spark, path, names)
        changed = F.broadcast(differ)  # at most `users` rows
        lost = public.join(changed.where("had").select("user"), "user", "left_semi").select("user", F.sha2("value", 256).alias("sha256"))
        lost = lost.join(kept.join(changed.where("had").select("user"), "user", "left_semi").select("user", F.sha2("line", 256).alias("sha256")), ["user", "sha256"], "left_anti")
        null = rows.where("tool is null or event_id is null or user is null")
        evidence = [(others, "collision"), (null, "null")]
        aside = [df.select("tool", "event_id", F.sha2("line", 256).alias("sha256"), F.lit(reason).alias("reason")) for df, reason in evidence]
        aside.append(lost.select(F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("event_id"), "sha256", F.lit("modified").alias("reason")))
        told = scratch.save(aside[0].unionByName(aside[1]).unionByName(aside[2]).distinct())
        if isolated:
            kind = "tool string, event_id string, sha256 string, reason string"
            new_events(told, read_or_empty(spark, isolated, kind), ("tool", "event_id", "sha256", "reason")).write.mode("append").parquet(isolated)
        part = F.pmod(F.xxhash64("event_id"), F.ceil(F.greatest(F.col("n_bytes"), F.lit(1)) / file_bytes).cast("long"))
        dealt = kept.join(changed.select("user", "n_bytes"), "user").withColumn("_part", part).repartition("user", "_part").sortWithinPartitions("user", "_part", "ts", "event_id")
        dealt.drop("_part", "n_bytes", "line").write.mode("append").partitionBy("user").options(**JSON).json(path)
        for file in old:
            fs.delete(file, False)
        if health:
            codes = {r["reason"] for r in told.select("reason").distinct().collect()}
            alert(spark, health, *(c for r, c in (("collision", "ID_COLLISION"), ("null", "UNPUBLISHED"), ("modified", "REGISTRY_DRIFT")) if r in codes))
        return sorted(names)
    except Exception:
        if health:
            with contextlib.suppress(Exception):  # the error itself matters more
                alert(spark, health, "PUBLICATION_FAILED")
        raise
    finally:
        scratch.end()


def write_quarantine(bad: DataFrame, path: str) -> None:
    """Appends evidence. Columns that could hold content are refused."""
    allowed = {"source", "path", "line_no", "n_bytes", "sha256", "reason"}
    if set(bad.columns) - allowed:
        raise ValueError(f"not evidence: {sorted(set(bad.columns) - allowed)}")
    bad.write.mode("append").parquet(path)


def write_health(codes: DataFrame, path: str) -> None:
    """Appends (ts, code). A code is a plain upper-case word; anything else, which could be content, is an error."""
    fine = F.col("code").isNotNull() & F.col("code").rlike("^[A-Z][A-Z0-9_]{0,63}$")
    checked = F.when(fine, F.col("code")).otherwise(F.raise_error(F.lit("not a health code")))
    codes.select("ts", checked.cast("string").alias("code")).write.mode("append").parquet(path)


def alert(spark: SparkSession, path: str, *codes: str) -> None:
    """Appends codes with the time of now, if there are any."""
    if codes:
        write_health(spark.createDataFrame([(c,) for c in codes], "code string").select(F.current_timestamp().alias("ts"), "code"), path)
