"""Strict decoding of JSON by a typed contract: which fields, of which kinds, at every level."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import free_name

#: What a variant's own type begins with, by kind, and the Spark type that it is read as.
KINDS = {"string": ("STRING",), "time": ("STRING",), "long": ("BIGINT",), "double": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
READ = {"string": "string", "time": "string", "long": "long", "double": "double", "boolean": "boolean"}
#: Kinds that are read as they are, without a look at what is in them.
SCALARS = ("string", "long", "double", "boolean")
#: A date and a time of day, with or without a fraction and a zone.
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


@dataclass(frozen=True)
class Field:
    """A field of an object. kind: one of KINDS. needed: it must be there, and not be null. An object
    has its own fields, and an array an item, whose name is not read."""

    name: str
    kind: str = "string"
    needed: bool = False
    fields: tuple[Field, ...] = ()
    item: Field | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind: {self.kind}")
        if '"' in self.name and "'" in self.name:
            raise ValueError("a path can't hold a name with both sorts of quotes")
        if (self.kind == "array") != (self.item is not None) or (self.fields and self.kind != "object"):
            raise ValueError(f"{self.name}: fields belong to an object, an item to an array")
        if len({f.name for f in self.fields}) < len(self.fields):
            raise ValueError(f"{self.name}: a field is repeated")

    @property
    def spark_type(self) -> str:
        if self.kind == "object":
            return f"struct<{', '.join(f'`{f.name}`: {f.spark_type}' for f in self.fields)}>"
        return f"array<{self.item.spark_type}>" if self.kind == "array" else "timestamp" if self.kind == "time" else READ[self.kind]


@dataclass(frozen=True)
class Contract:
    """The fields of a line. forbidden: names whose presence refuses a line for a reason of its own."""

    fields: tuple[Field, ...]
    forbidden: tuple[str, ...] = ()

    @property
    def whole(self) -> Field:
        return Field("line", "object", True, self.fields)

    def but(self, *more: Field) -> Contract:
        return Contract((*self.fields, *more), self.forbidden)


def strings(names: Sequence[str], needed: Sequence[str] = ()) -> tuple[Field, ...]:
    return tuple(Field(n, needed=n in needed) for n in names)


def parsed(raw: Column, limit: int | None = None) -> Column:
    """The line as a variant; null if it is longer than limit bytes, or not exactly one JSON value
    without repeated keys.

    Parsers stop behind the first value. So the line is put into an object in which a second key comes
    behind it, the line's own digest, which no line can hold: had the parser stopped early, it was
    not there.
    """

    def value(text: Column) -> Column:
        around = lambda key: F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"'), key, F.lit('":0}'))), "$", "map<string,variant>")
        return let(F.sha2(text, 256), lambda key: let(around(key), lambda m: F.when(F.map_contains_key(m, key) & (F.size(m) == 2), m["v"])))

    return let(let(raw, lambda r: F.when(F.octet_length(r) <= limit, F.trim(r))) if limit else F.trim(raw), value)


def _at(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{name}']" if '"' in name else f'$["{name}"]', kind)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Binds a value to a lambda's variable, so that it is computed once even where a filter takes the
    whole expression along."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is(v: Column, kind: str) -> Column:
    if kind in ("object", "array"):
        return F.try_variant_get(v, "$", "map<string,variant>" if kind == "object" else "array<variant>").isNotNull()
    own = F.schema_of_variant(v)
    test = F.lit(False)
    for begin in KINDS[kind]:
        test |= own.startswith(begin)
    return test


def time_of(text: Column) -> Column:
    """A timestamp, or null if the text is none. Times without a day, or days without a time, are none."""
    return F.when(text.rlike(TIME), text.try_cast("timestamp"))


#: Why a line is refused, the first that holds anywhere in it.
REASONS = ("malformed", "forbidden", "unknown", "missing", "null", "type", "time", "ok")
OK = len(REASONS) - 1


def _place(reason: str) -> Column:
    return F.lit(REASONS.index(reason))


def _members(v: Column) -> Column:
    """An object's values by name; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _object_code(members: Column, f: Field, forbidden: Sequence[str] = ()) -> Column:
    keys = F.map_keys(members)
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    out = F.when(F.arrays_overlap(keys, names(forbidden)), _place("forbidden")) if forbidden else F.when(F.lit(False), OK)
    more = F.size(F.array_except(keys, names([x.name for x in f.fields]))) > 0
    return out.when(more, _place("unknown")).otherwise(F.least(F.lit(OK), F.lit(OK), *[_code_in(members, x) for x in f.fields]))


def _code(v: Column, f: Field) -> Column:
    """The place in REASONS of what is wrong with a field's value and all below it. Either may be missing
    or null, if the field is not needed."""
    missing, null = (_place("missing"), _place("null")) if f.needed else (F.lit(OK), F.lit(OK))
    there = F.when(v.isNull(), missing).when(F.is_variant_null(v), null)
    if f.kind == "object":
        return there.otherwise(let(_members(v), lambda m: F.when(m.isNull(), _place("type")).otherwise(_object_code(m, f))))
    if f.kind == "array":
        items = F.try_variant_get(v, "$", "array<variant>")
        worst = lambda xs: F.when(xs.isNull(), _place("type")).otherwise(F.coalesce(F.array_min(F.transform(xs, lambda x: _code(x, f.item))), F.lit(OK)))
        return there.otherwise(let(items, worst))
    there = there.when(~_is(v, f.kind), _place("type"))
    return there.when(time_of(F.try_variant_get(v, "$", "string")).isNull(), _place("time")).otherwise(OK) if f.kind == "time" else there.otherwise(OK)


def _code_in(members: Column, f: Field) -> Column:
    return let(members[f.name], lambda own: _code(own, f))


def verdict(line: Column, contract: Contract) -> Column:
    """ok, or why a parsed line is refused: malformed, forbidden, unknown, missing, null, type or time,
    in this order of reasons, whatever their place."""
    code = lambda v: let(_members(v), lambda m: F.when(m.isNull(), 0).otherwise(_object_code(m, contract.whole, contract.forbidden)))
    return F.get(F.array(*[F.lit(r) for r in REASONS]), let(line, code))


def _read(v: Column, f: Field) -> Column:
    if f.kind == "object":
        return F.when(_is(v, "object"), F.struct(*[_read(_at(v, x.name), x).alias(x.name) for x in f.fields]))
    if f.kind == "array":
        return F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _read(x, f.item))
    return time_of(F.try_variant_get(v, "$", "string")) if f.kind == "time" else F.try_variant_get(v, "$", READ[f.kind])


def fields_of(v: Column, contract: Contract) -> list[Column]:
    """The contract's fields as typed columns; what can't be read as its kind is null."""
    return [(_at(v, f.name, READ[f.kind]) if f.kind in SCALARS else _read(_at(v, f.name), f)).alias(f.name) for f in contract.fields]


def judge(lines: DataFrame, contract: Contract, limit: int | None = None, raw: str = "raw", also: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """lines with `reason`. also: from the parsed line and the reason, another one.

    A line is parsed once, within the one expression. Null lines are malformed.
    """
    found = lambda v, r: also(v, r) if also else r
    return lines.withColumn("reason", _judged(F.col(raw), contract, limit, found))


def _judged(raw: Column, contract: Contract, limit: int | None, use: Callable[[Column, Column], Column]) -> Column:
    """What use makes of the parsed line and the reason. The line itself is computed once, too: a filter takes along the expression that makes it."""

    def told(line: Column) -> Column:
        reason = lambda v: F.when(F.octet_length(line) > limit, "oversize").otherwise(verdict(v, contract)) if limit else verdict(v, contract)
        return let(parsed(line, limit), lambda v: let(reason(v), lambda r: use(v, r)))

    return let(raw, told)


def accept(lines: DataFrame, contract: Contract, fields: Contract, limit: int | None = None, raw: str = "raw") -> DataFrame:
    """The lines that the contract accepts, with fields as typed columns in the place of raw. A line is parsed once
    for both: a generator leaves the others out, as a filter would take the whole expression below and parse again.
    """
    read = _judged(F.col(raw), contract, limit, lambda v, r: F.when(r == "ok", F.array(F.struct(*fields_of(v, fields)))))
    return lines.select(*[F.col(f"`{c}`") for c in lines.columns if c != raw], F.inline(read))


def decode(lines: DataFrame, contract: Contract, raw: str = "raw") -> DataFrame:
    """lines with the contract's fields as columns in the place of raw; null where a line is null."""
    v = free_name(lines, "_v")
    rest = [F.col(f"`{c}`") for c in lines.columns if c != raw]
    return lines.withColumn(v, parsed(F.col(raw))).select(*rest, *fields_of(F.col(v), contract))
