"""Validation, scope and projection: rows in, rows out, no shuffle but for anti joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import Contract, Field, accept, decode, judge, strings
from ..functions.text import canonical, digest, redact, truncate_bytes, version_at_least, within
from ..policy import ENVELOPE_FORBIDDEN, ENVELOPE_REQUIRED, EVENT_FIELDS, Policy

#: An event, a transcript's line, which also tells who spoke and where, and a captured envelope.
EVENT = Contract(tuple(Field(n, "time" if n == "ts" else "string", n in ("event_id", "tool", "session_id", "prompt")) for n in EVENT_FIELDS))
LINE = EVENT.but(Field("role"), Field("cwd"))
ENVELOPE = Contract((*strings(ENVELOPE_REQUIRED, ENVELOPE_REQUIRED), *strings(("hook_event_name", "transcript_path", "model")), Field("ts", "time")), ENVELOPE_FORBIDDEN)


def judge_lines(lines: DataFrame, policy: Policy = Policy(), contract: Contract = EVENT, raw: str = "raw") -> DataFrame:
    """lines with `reason`: ok, or why the contract refuses the line."""
    return judge(lines, contract, policy.line_bytes, raw)


def judge_envelopes(lines: DataFrame, policy: Policy = Policy(), contract: Contract = ENVELOPE, raw: str = "raw") -> DataFrame:
    """lines with `reason` under the envelope's contract; a sub-agent's marks are refused."""
    return judge(lines, contract, policy.envelope_bytes, raw)


def accepted(judged: DataFrame, contract: Contract = EVENT, raw: str = "raw") -> DataFrame:
    """The accepted lines as typed columns, of those fields that the contract names."""
    return decode(judged.where("reason = 'ok'").drop("reason"), contract, raw)


def accept_lines(lines: DataFrame, policy: Policy = Policy(), contract: Contract = EVENT, fields: Contract | None = None, raw: str = "raw") -> DataFrame:
    """What accepted gives of judge_lines, in one pass: the accepted lines as typed columns, those of fields or else of the contract."""
    return accept(lines, contract, fields or contract, policy.line_bytes, raw)


def accept_envelopes(lines: DataFrame, policy: Policy = Policy(), contract: Contract = ENVELOPE, fields: Contract | None = None, raw: str = "raw") -> DataFrame:
    """What accepted gives of judge_envelopes, in one pass."""
    return accept(lines, contract, fields or contract, policy.envelope_bytes, raw)


def quarantined(judged: DataFrame, raw: str = "raw") -> DataFrame:
    """Refused lines as evidence: where, how long, digest and reason; never their content."""
    where = [c for c in ("source", "path", "line_no") if c in judged.columns]
    return judged.where("reason <> 'ok'").select(*where, F.octet_length(raw).cast("long").alias("n_bytes"), digest(F.col(raw)).alias("sha256"), "reason")


def torn_tails(files: DataFrame) -> DataFrame:
    """(path, n_bytes, sha256) of what follows the last newline in files (path, content)."""
    tail = F.when(F.instr(F.col("content").cast("string"), "\n") > 0, F.element_at(F.split(F.col("content").cast("string"), "\n"), -1)).otherwise(F.col("content").cast("string"))
    return files.withColumn("_tail", tail).where(F.length("_tail") > 0).select("path", F.octet_length("_tail").cast("long").alias("n_bytes"), digest(F.col("_tail")).alias("sha256"))


def partial_sources(judged: DataFrame, by: str = "path") -> DataFrame:
    """Which sources had a malformed or oversize line."""
    return judged.groupBy(by).agg(F.bool_or(F.col("reason").isin("malformed", "oversize")).alias("partial"))


def human(rows: DataFrame, role: str = "role") -> DataFrame:
    return rows.where(F.col(role) == "user")


def of_kinds(rows: DataFrame, kinds: Sequence[str] = ("SessionStart", "UserPromptSubmit"), column: str = "hook_event_name") -> DataFrame:
    return rows.where(F.col(column).isin(*kinds))


def with_markers(rows: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Rows that carry all of a provider's markers, so that no other client captures them again."""
    keep: Column = F.lit(True)
    for m in markers:
        keep &= F.col(m).isNotNull()
    return rows.where(keep)


def in_scope(rows: DataFrame, root: str, nested: DataFrame, cwd: str = "cwd") -> tuple[DataFrame, DataFrame]:
    """(inside, deferred): rows below root and below no nested repository (nested: one column
    `root`); rows whose cwd is unknown are tried again later and must not advance a cursor. Paths are
    compared in their canonical form, and one that is not absolute is in no repository.

    Each different folder meets nested by all folders above it, an equality that needs no loop over
    nested roots.
    """
    known = rows.where(within(F.col(cwd), F.lit(root)))
    parts = F.split(canonical(F.col(cwd)), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    roots = nested.select(canonical(F.col("root")).alias("_root")).distinct()
    inner = known.select(cwd).distinct().withColumn("_root", F.explode(above)).join(roots, "_root", "left_semi").select(cwd).distinct()
    return known.join(inner, cwd, "left_anti"), rows.where(F.col(cwd).isNull())


def stable_clients(rows: DataFrame, floors: dict[str, str], tool: str = "tool", version: str = "version") -> DataFrame:
    """Rows of tools at or above their least stable version. Tools without a floor pass."""
    test: Column = F.lit(True)
    for name, floor in floors.items():
        test = F.when(F.col(tool) == name, version_at_least(F.col(version), floor)).otherwise(test)
    return rows.where(test)


def publishable(rows: DataFrame, tools: Sequence[str], user: str, repo: str) -> DataFrame:
    """Rows whose tool, user and project are the expected ones."""
    return rows.where(F.col("tool").isin(*tools) & (F.col("identity") == user) & (F.col("repo") == repo))


def retained(rows: DataFrame, now: Column, policy: Policy = Policy(), ts: str = "ts") -> DataFrame:
    """Rows younger than the retention, on the event's own time; the last instant is kept."""
    return rows.where(F.col(ts) >= now - F.make_interval(days=F.lit(policy.retention_days)))


def conform(rows: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Provider names to ours."""
    return rows.withColumnsRenamed({k: v for k, v in aliases.items() if k in rows.columns})


def to_events(rows: DataFrame, repo: str, device: str, policy: Policy = Policy(), keep: Sequence[str] = ()) -> DataFrame:
    """The event contract: redacted and limited prompts, the identity or else the device, and a
    flag where redaction grew a prompt beyond the limit. keep: columns that stay beside it."""
    safe = redact(F.col("prompt")) if policy.redact else F.col("prompt")
    return rows.select(
        *keep,
        "event_id", "tool", "session_id", "ts",
        truncate_bytes(safe, policy.prompt_bytes, policy.mark).alias("prompt"),
        F.coalesce("identity", F.lit(device)).alias("identity"),
        F.sha2(F.lit(repo), 256).alias("repo"), "branch", "commit",
        (F.octet_length(safe) > policy.prompt_bytes).alias("truncated"),
    )
