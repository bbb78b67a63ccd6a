"""Direct captures: envelopes of trusted clients become events, in a batch or as a step of a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from ..operators.filters import ENVELOPE, accepted, in_scope, judge_envelopes, of_kinds, quarantined, stable_clients, to_events, with_markers
from ..operators.matching import first_per_id
from ..policy import EVENT_FIELDS, Policy
from ..sources.files import alert
from .recover import Watched, append_evidence, not_stored, put, writing
from .store import Store


@dataclass(frozen=True)
class Capture:
    """What captures go by. floors: the least stable version of a tool. markers: columns that a tool's lines
    must carry, so that no other client captures its prompts again; tools without any need none. root: the repository's
    folder; without it all is in scope. nested, repo and device as for a recovery."""

    floors: dict[str, str] = field(default_factory=dict)
    markers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    root: str | None = None
    nested: tuple[str, ...] = ()
    repo: str = "local"
    device: str = "device"
    policy: Policy = field(default_factory=Policy)


def trusted(rows: DataFrame, rules: Capture) -> DataFrame:
    """Rows of clients that are new enough and carry their markers. A tool that is null is no client."""
    known = stable_clients(rows.where("tool is not null"), rules.floors)
    for tool, markers in rules.markers.items():
        known = known.where(F.col("tool") != tool).unionByName(with_markers(known.where(F.col("tool") == tool), markers))
    return known


def captured(judged: DataFrame, rules: Capture = Capture()) -> DataFrame:
    """Events, redacted, of judged envelopes (raw, reason, tool, version, and the columns of markers).

    A turn's id is the event's, an envelope without a kind is a prompt, and one without a time has that of
    `received` if there is such a column, else the present. Envelopes of other kinds, of clients that aren't trusted, and
    from outside the repository are left out; they are neither events nor evidence. Repeats stay: the store's
    ids decide. An empty prompt is an event; an empty table gives none.
    """
    extra = [c for c in judged.columns if c in ENVELOPE_OWN]
    rows = trusted(accepted(judged.drop(*extra), ENVELOPE), rules)
    rows = of_kinds(rows.fillna("UserPromptSubmit", ["hook_event_name"]), ("UserPromptSubmit",))
    if rules.root is not None:
        rows, _unknown = in_scope(rows, rules.root, rows.sparkSession.createDataFrame([(r,) for r in rules.nested], "root string"))
    now = F.col("received") if "received" in rows.columns else F.current_timestamp()
    own = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    shaped = rows.select(F.col("turn_id").alias("event_id"), "tool", "session_id", F.coalesce("ts", now).alias("ts"), "prompt", *[own(n).alias(n) for n in ("identity", "branch", "commit")])
    return to_events(shaped, rules.repo, rules.device, rules.policy)


#: Columns of a line that an envelope's own fields replace.
ENVELOPE_OWN = tuple(f.name for f in ENVELOPE.fields)


def capture_batch(store: str | Store, quarantine: str, rules: Capture = Capture(), health: str | None = None, writer: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step over lines (path, line_no, raw, tool, version, markers): refused envelopes become
    evidence, the others direct captures, each id once for good, so a batch that runs again appends nothing.

    Only judged and redacted rows are written. health: where QUARANTINED, PROMPT_TRUNCATED and CLIENT_REFUSED go. writer: the name under
    which a store in buckets remembers the last batch.
    """

    def step(lines: DataFrame, batch: int) -> None:
        watched = Watched(Scratch(lines.sparkSession))
        judged = judge_envelopes(lines, rules.policy)
        bad = watched.save("refused", quarantined(judged))
        append_evidence(bad, quarantine)
        good = judged.where("reason = 'ok'")
        # (tool, version, markers) of what clients sent, without its content
        facts = [c for c in dict.fromkeys(("tool", "version", *(m for ms in rules.markers.values() for m in ms))) if c in lines.columns]
        sent = good.select(*facts)
        events = watched.save("captured", first_per_id(captured(judged, rules)), truncated=F.count_if("truncated"))
        with writing():
            put(not_stored(events.select(*EVENT_FIELDS), store, watched.scratch), store, "direct", writer, batch if writer else None)
        if health:
            strange = not sent.exceptAll(trusted(sent, rules)).isEmpty()
            found = {"QUARANTINED": watched["refused"], "PROMPT_TRUNCATED": watched["truncated"], "CLIENT_REFUSED": strange}
            alert(lines.sparkSession, health, *(c for c, n in found.items() if n))
        watched.scratch.end()

    return step
