"""Transcripts of other shapes: which kinds of a client's lines are a person's prompts, and where their fields are."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.schema import let, time_of
from ..policy import EVENT_FIELDS

FIELDS = (*EVENT_FIELDS, "role", "cwd")
NEEDED = ("event_id", "session_id", "prompt")


@dataclass(frozen=True)
class Place:
    """Where a value is: the first of paths that has one, such as $.message.content. If that is a list, the
    texts at `item` of those elements whose `kind` is among `kinds` are joined by line breaks."""

    paths: tuple[str, ...]
    item: str = "$.text"
    kind: str = "$.type"
    kinds: tuple[str, ...] = ("text",)

    def text(self, v: Column) -> Column:
        """A string; null where there is none, or something else stands there."""

        def one(x: Column) -> Column:
            parts = F.filter(F.try_variant_get(x, "$", "array<variant>"), lambda p: F.try_variant_get(p, self.kind, "string").isin(*self.kinds))
            joined = F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: _string(F.try_variant_get(p, self.item, "variant"))), "\n"))
            return F.coalesce(_string(x), joined)

        return F.coalesce(*[let(F.try_variant_get(v, p, "variant"), one) for p in self.paths])


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


@dataclass(frozen=True)
class Adapter:
    """A client's transcripts. tool: its name in events. files: a pattern that finds its files' paths. kind: where
    a line says what it is, and human: the kinds that are a person's prompts. fields: the places of an
    event's fields. An event without an id of its own goes by session and time."""

    tool: str
    files: str
    kind: str
    human: tuple[str, ...]
    fields: Mapping[str, Place] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if odd := set(self.fields) - (set(FIELDS) - {"tool"}):
            raise ValueError(f"no fields of an event: {sorted(odd)}")

    def event(self, v: Column) -> Column:
        """struct(reason, fields of a line) of a parsed line. Only the places that are named are read, so
        responses, and whatever else such a line may have, go no further. A line of another kind is `other`."""
        of = lambda n: self.fields[n].text(v) if n in self.fields else F.lit(None).cast("string")
        raw = F.struct(*[of(n).alias(n) for n in FIELDS if n != "tool"])

        def told(e: Column) -> Column:
            own = F.coalesce(e["event_id"], F.when(e["session_id"].isNotNull() & e["ts"].isNotNull(), F.concat_ws("/", e["session_id"], e["ts"])))
            lacks = own.isNull()
            for n in NEEDED[1:]:
                lacks |= e[n].isNull()
            kind = F.try_variant_get(v, self.kind, "string")
            human = F.coalesce(kind.isin(*self.human), F.lit(False))
            reason = F.when(v.isNull(), "malformed").when(~human, "other").when(lacks, "missing").when(e["ts"].isNotNull() & time_of(e["ts"]).isNull(), "time").otherwise("ok")
            value = {"event_id": own, "tool": F.lit(self.tool), "ts": time_of(e["ts"])}
            return let(reason, lambda r: F.struct(r.alias("reason"), *[F.when(r == "ok", value.get(n, e[n] if n != "tool" else None)).alias(n) for n in FIELDS]))

        return let(raw, told)


def event_at(path: Column, v: Column, adapters: tuple[Adapter, ...], otherwise: Column) -> Column:
    """The event by the first adapter whose files the path is among, else what is given."""
    out = otherwise
    for a in reversed(adapters):
        out = F.when(path.rlike(a.files), a.event(v)).otherwise(out)
    return out
