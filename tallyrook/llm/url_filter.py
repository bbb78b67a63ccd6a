"""URL rules as globs, matched all at once by bit-parallel Shift-And."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path) of the rules that always hold.
BASE = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs over host and path that block what no rule decides. * stays within a host or a path's
#: part, ** crosses them, ? is one character.
GLOBS = ("**casino**", "**free-bets**", "**cheap-pills**", "**spam-farm**", "**ads-track**", "**adult-**", "**/login?*/**", "**.exe")


@dataclass(frozen=True)
class Automaton:
    """Multiword Shift-And masks: bit i of a pattern says that i of its characters are read.

    step[w, c]: states that character c moves on; stay[w, c]: states at a wildcard that c keeps;
    first: the patterns' first states; last: each one's last. Masks have one 64-bit word for each 64 states.
    """

    step: np.ndarray
    stay: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @staticmethod
    def of(globs: Sequence[str]) -> Automaton:
        chars: list[int | None] = []  # the byte that leaves a state; None any; -1 a last state
        loops: list[str] = []
        first, last = [], []
        for g in globs:
            first.append(len(chars))
            data, i, loop = g.encode(), 0, ""
            while i <= len(data):
                if data[i : i + 2] == b"**":
                    loop, i = "**", i + 2
                elif data[i : i + 1] == b"*":
                    loop, i = loop or "*", i + 1
                else:
                    chars.append(-1 if i == len(data) else None if data[i] == 63 else data[i])
                    loops.append(loop)
                    loop, i = "", i + 1
            last.append(len(chars) - 1)
        n = -(-len(chars) // 64)
        step, stay = (np.zeros((n, 256), np.uint64) for _ in range(2))
        for s, (c, loop) in enumerate(zip(chars, loops)):
            bit = np.uint64(1 << (s % 64))
            if c is None:
                step[s // 64] |= bit
            elif c >= 0:
                step[s // 64, c] |= bit
            if loop:
                stay[s // 64] |= bit
            if loop == "*":
                stay[s // 64, ord("/")] &= ~bit
        start = np.zeros(n, np.uint64)
        for a in first:
            start[a // 64] |= np.uint64(1 << (a % 64))
        return Automaton(step, stay, start, np.array(last, np.int64))

    def match(self, strings: Sequence[bytes]) -> np.ndarray:
        """Which pattern takes which whole string: bool[string, pattern]. All strings advance a
        byte together; those that have ended stand aside."""
        n = len(strings)
        size = np.fromiter((len(s) for s in strings), np.int64, n)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        flat = np.frombuffer(b"".join(strings[i] for i in order), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        state = np.repeat(self.first[None, :], n, axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for i in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size[:live], -i, side="left"))  # strings longer than i
            c = flat[at[:live] + i]
            now = state[:live]
            moved = now & self.step[:, c].T
            up = moved << one
            up[:, 1:] |= moved[:, :-1] >> top
            state[:live] = up | (now & self.stay[:, c].T)
        # a pattern has matched if its last bit is set, which stands in one word
        got = np.empty((n, len(self.last)), bool)
        for k, s in enumerate(self.last.tolist()):
            got[:, k] = state[:, s // 64] >> np.uint64(s % 64) & one
        out = np.empty_like(got)
        out[order] = got
        return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host in lower-case A-Z and path; both empty for a null or a url without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("x"), url), "://", 1))
    tail = F.coalesce(url.substr(F.length(rest) + 3, F.length(url)), F.lit(""))
    host = F.regexp_extract(tail, "^([^/?#]*)", 1)
    path = F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = BASE, globs: Sequence[str] = GLOBS, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    A rule becomes two globs, its host and all subdomains, and all rules and globs run in one
    automaton. The longest rule that fits decides; without one, a glob blocks, else allow. Null,
    empty and broken urls have an empty host and path, no rule, and what the globs say (allow).
    Very long urls cost time by their length. Columns of these names are replaced. One pass,
    no shuffle.
    """
    fixed = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    patterns = [p for _, h, path in fixed for p in (f"{h}{path}**", f"*.{h}{path}**")] + list(globs)
    auto = Automaton.of(patterns)
    m = len(fixed)

    @F.pandas_udf("rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        got = auto.match([u.encode() for u in urls])
        fits = got[:, 0 : 2 * m : 2] | got[:, 1 : 2 * m : 2] if m else np.zeros((len(urls), 0), bool)
        best = np.where(fits.any(axis=1), fits.argmax(axis=1), m) if m else np.full(len(urls), m)
        rule = np.array([h + p for _, h, p in fixed] + [None], object)[best]
        other = np.where(got[:, 2 * m :].any(axis=1), "block", "allow")
        verdict = np.where(best == m, other, np.array([v for v, _, _ in fixed] + [""], object)[best])
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    host, path = host_path(F.col(url_col))
    # the caller's columns stay wrapped, so that none can clash with those between
    wrapped = pages.drop("host", "path", "rule", "verdict").select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    out = wrapped.withColumn("judged", judge(F.concat("host", "path")))
    return out.select("row.*", "host", "path", "judged.rule", "judged.verdict")


def report(judged: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The columns of op6."""
    return judged.select(F.col(id_col).alias("page_id"), "host", "path", "rule", "verdict")
