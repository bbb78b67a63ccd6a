"""Secrets found through an inverted index of trigrams."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, body, counted, listed, no_spans, sha, spans

#: At most so many ways to read one rule before it counts as having no mandatory trigram.
MAX_WAYS = 256


@dataclass(frozen=True)
class Rule:
    """kind: the name in spans. pattern: Java's and Python's syntax alike. least: the shortest
    group (0: the match) that counts. run: a pattern that finds a text with a match, for rules
    without mandatory trigrams. fast: the same matches in Java's syntax alone, where the plain
    pattern would recurse or go back over long texts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    run: str = ""
    fast: str = ""

    def keep(self) -> Callable[[Column], Column] | None:
        if not self.least:
            return None
        part = (lambda h: F.regexp_extract(h, self.pattern, self.group)) if self.group else (lambda h: h)
        return lambda h: F.length(part(h)) >= self.least


#: The three kinds that are always reported, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)
#: A private key runs to its END line, with no other run of five dashes between. Where END is missing it
#: takes what follows in base64: whole lines, lines after a written \n, and words of 40 characters or more.
PEM, PEM_END = r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", r"-----END [A-Z ]{0,32}PRIVATE KEY-----"
PEM_LINE = r"[\x20\t\r]*\n[\x20\t\r\n>]*(?:(?:Proc-Type|DEK-Info):[^\n]*|[A-Za-z0-9+/=]+[\x20\t\r]*(?m:$))"
PEM_REST = rf"[A-Za-z0-9+/=]*(?:[\x20\t\r\n>]+[A-Za-z0-9+/=]{{40,}}|(?:\\[nr])+[A-Za-z0-9+/=]*|{PEM_LINE})*"
SEGMENT = "[A-Za-z0-9_-]{8,}"
#: Published shapes of credentials.
MORE = (
    Rule("pem", rf"{PEM}(?:[^-]*(?:-{{1,4}}[^-]+)*{PEM_END}|{PEM_REST})", fast=rf"{PEM}(?:[^-]*+(?:-{{1,4}}[^-]++)*+{PEM_END}|{PEM_REST.replace('(?m:', '(?dm:')}+)"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    # A JWT that fails at a run's first eyJ fails at the later ones, too; fast leaves those within 1000 characters out.
    Rule("jwt", rf"eyJ{SEGMENT}\.eyJ{SEGMENT}\.{SEGMENT}", fast=rf"eyJ(?<!eyJ[A-Za-z0-9_-]{{0,1000}}eyJ){SEGMENT}+\.eyJ{SEGMENT}+\.{SEGMENT}+"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + MORE


_GROUP, _QUANTIFIER = re.compile(r"\((?:\?[a-z]*:)?"), re.compile(r"([?*+])|\{(\d+)(,?)(\d*)\}")
_CHAR = re.compile(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\([^a-zA-Z0-9])|([^\\])", re.S)
#: What stands for characters that are not known; fragments on its two sides need not touch.
GAP = [("", "")]


def _class(part: str) -> list[tuple[str, ...]]:
    """The characters of a class that lists at most eight of them; a gap for any other."""
    chars = [m for m in _CHAR.finditer(part)]
    if part.startswith("^") or "-" in part[1:-1] or sum(m.end() - m.start() for m in chars) != len(part) or len(chars) > 8:
        return GAP
    return [(_literal(m),) for m in chars]


def _literal(m: re.Match) -> str:
    return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else m[3] or m[4]


def _ways(pattern: str, i: int = 0) -> tuple[list[tuple[str, ...]], int]:
    """All ways to read a pattern from i on to its end or the group's, each as literal fragments, and
    where that is. What is not a literal, a short class, a group, a choice or a repeat is a gap. Too
    many ways count as one without literals."""
    done: list[tuple[str, ...]] = []
    ways: list[tuple[str, ...]] = [("",)]
    while i < len(pattern) and pattern[i] != ")":
        c = pattern[i]
        if c == "|":
            done, ways, i = done + ways, [("",)], i + 1
            continue
        if c == "(":
            if not (m := _GROUP.match(pattern, i)) or pattern.startswith("?", m.end()):
                raise ValueError(f"no group that is understood, at {i} of {pattern!r}")
            step, i = _ways(pattern, m.end())
            i += 1
        elif c == "[":
            end = re.compile(r"\^?\]?(?:\\.|[^\]\\])*\]", re.S).match(pattern, i + 1).end()
            step, i = _class(pattern[i + 1 : end - 1]), end
        elif c not in ".^$" and (m := _CHAR.match(pattern, i)):
            step, i = [(_literal(m),)], m.end()
        else:
            step, i = GAP, i + (2 if c == "\\" else 1)
        if m := _QUANTIFIER.match(pattern, i):
            low = {"?": 0, "*": 0, "+": 1}[m[1]] if m[1] else int(m[2])
            once = m[1] == "?" or (not m[1] and (low, m[3], m[4]) == (0, ",", "1"))
            step = [("",), *step] if once else [(*w, "", *w) if low > 1 else (*w, "") for w in step] if low else GAP
            i = m.end() + (pattern[m.end() : m.end() + 1] in ("?", "+"))
        ways = list({(*x[:-1], x[-1] + y[0], *y[1:]) for x, y in product(ways, step)})
        if len(ways) > MAX_WAYS:
            ways = GAP
    return list(dict.fromkeys(done + ways)), i


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams, folded to lower case: a match has all of one alternative.
    None: the pattern has no mandatory trigram, and every text must be read."""
    ways, end = _ways(pattern)
    if end < len(pattern):
        raise ValueError(f"a group ends that did not begin, at {end} of {pattern!r}")
    sets = {frozenset(f[i : i + 3].lower() for f in way for i in range(len(f) - 2)) for way in ways}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


#: A text is read in parts of so many characters, which bounds the trigrams that are held at once.
PART = 1 << 16


def _one_of(grams: Sequence[str]) -> str:
    """A pattern for any of the trigrams, as a tree over their characters."""
    own = lambda c: f"\\u{ord(c):04x}"
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(grams):
        tree.setdefault(a, {}).setdefault(b, []).append(c)
    return "|".join(own(a) + "(?:" + "|".join(own(b) + "[" + "".join(map(own, cs)) + "]" for b, cs in bs.items()) + ")" for a, bs in tree.items())


def held_grams(text: Column, grams: Sequence[str]) -> Column:
    """Which of the trigrams a lower-case text holds, each once, by one pass over it."""
    if not grams:
        return F.array().cast("array<string>")
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{PART + 2}}})).{{1,{PART}}}"), F.lit(1))
    found = lambda p: F.array_distinct(F.regexp_extract_all(p, F.lit(f"(?=({_one_of(grams)}))"), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(parts, found)))


def postings(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index as (trigram, id): one posting for each trigram of the queries that a
    text holds, and one under the rule's own name for texts that a full scan has found. However
    many trigrams the rules have, a text is read once for them all."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for s in q or () for g in s})
    scans = [F.when(F.col("_text").rlike(r.run or r.pattern), F.lit(f"scan:{r.kind}")) for r in rules if queries[r.kind] is None]
    text = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("_text"))
    found = F.concat(held_grams(F.lower("_text"), grams), F.array_compact(F.array(*scans)).cast("array<string>"))
    return text.select("_id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, kinds): intersects the postings of each alternative, then unites alternatives."""
    clauses = []
    for r in rules:
        for n, grams in enumerate(trigram_query(r.pattern) or [frozenset([f"scan:{r.kind}"])]):
            clauses += [(g, r.kind, n, len(grams)) for g in sorted(grams)]
    # one row for each trigram of the rules: as large as the rules, whatever the data
    plan = F.broadcast(docs.sparkSession.createDataFrame(clauses, "trigram string, kind string, clause int, need int"))
    met = postings(docs, rules, id_col, text_col).join(plan, "trigram").groupBy("_id", "kind", "clause", "need").agg(F.count_distinct("trigram").alias("have"))
    return met.where("have = need").groupBy("_id").agg(F.collect_set("kind").alias("kinds"))


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column `secrets`: the sorted spans array<struct<start,k,end,kind,hit>>.

    Each rule's regular expression runs only over texts that its postings leave; a rule without
    mandatory trigrams reads every text. All rows and columns stay. A null or empty text has no
    spans; repeated ids share candidates, which only adds texts to verify; a column named
    `secrets` is replaced.
    """
    found = Scratch(docs.sparkSession).save(candidates(docs, rules, id_col, text_col))
    out = docs.drop("secrets").alias("d").join(found.alias("c"), F.col(f"d.{id_col}").eqNullSafe(F.col("c._id")), "left")
    text = F.coalesce(F.col(f"d.{text_col}"), F.lit(""))
    parts = [F.when(F.array_contains(F.col("c.kinds"), r.kind), spans(text, r.fast or r.pattern, k, r.kind, r.keep())).otherwise(no_spans()) for k, r in enumerate(rules)]
    return out.select("d.*", F.when(F.col("c.kinds").isNull(), no_spans()).otherwise(F.array_sort(F.concat(*parts))).alias("secrets"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the spans of `secrets` replaced by a mark; spans that overlap are one. Null and empty
    texts, and texts without spans, stay as they are; all rows and other columns stay."""

    def cut(text: Column, found: Column) -> Column:
        step = F.aggregate(
            found,
            F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
            lambda a, s: F.struct(
                F.greatest(a["at"], s["end"]).alias("at"),
                F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))).alias("out"),
            ),
            lambda a: F.concat(F.array_join(a["out"], ""), text.substr(a["at"] + 1, F.length(text).cast("long"))),
        )
        return step

    return docs.withColumn(text_col, F.when(F.size("secrets") > 0, cut(F.col(text_col), F.col("secrets"))).otherwise(F.col(text_col)))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of op1."""
    base = F.filter("secrets", lambda s: s["k"] < len(BASE))
    counts = [counted("secrets", r.kind) for r in BASE]
    return scanned.select(F.col(id_col).alias("doc_id"), *counts, sha(listed(base)).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
