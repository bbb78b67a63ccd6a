"""Toxicity by a weighted finite-state grammar of clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, body, release, small_batches, words

#: Closed word classes in English, German, French and Spanish.
TARGET = "you your yours yourself u he she they them his her their du dich dir ihr euch dein deine er sie tu toi te vous votre ton il elle ils elles eres usted tú ti vosotros ellos ellas".split()
NEGATION = "not no never neither nor isn't aren't wasn't don't doesn't didn't without nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin tampoco".split()
REPORT = "said says say told tells wrote writes called quoted reported according alleged sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según".split()
THREAT = "kill hurt destroy beat stab shoot punch burn hang töten umbringen schlagen vernichten zerstören tuer frapper détruire brûler matar golpear destruir quemar".split()
CLASSES = ("other", "insult", "threat", "target", "negation", "report", "end")
OTHER, INSULT, HURT, WHOM, NOT, SAYS, END = range(7)
#: Lengths of a stem: the beginning that several words of the lexicon share.
STEMS = range(5, 10)
#: Words that a task remembers at once; those forgotten are classed again when they come back.
REMEMBER = 100_000


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) to (state, factor). A pair without an arc stays in its state; the end
    of a clause goes back to 0."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, float]]

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (0 if symbol == END else state, 1.0))


def _negating(damp: float, reach: int) -> Transducer:
    """After a negation the next words within reach count less."""
    arcs: dict = {(s, NOT): (reach, 1.0) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, damp if x in (INSULT, HURT) else 1.0) for x in (OTHER, INSULT, HURT, WHOM, SAYS)}
    return Transducer(reach + 1, arcs)


def _reporting(damp: float) -> Transducer:
    """What follows a verb of saying in its clause is another's speech."""
    return Transducer(2, {(0, SAYS): (1, 1.0), (1, INSULT): (1, damp), (1, HURT): (1, damp)})


def _targeting(lift: float) -> Transducer:
    """An insult after its target counts more."""
    return Transducer(2, {(0, WHOM): (1, 1.0), (1, INSULT): (1, lift), (1, HURT): (1, lift)})


def _threatening(follow: float) -> Transducer:
    """A threat counts little until its target follows, as most such verbs have harmless objects."""
    return Transducer(2, {(0, HURT): (1, 0.2), (1, HURT): (1, 0.2), (1, WHOM): (0, follow)})


def _heaping(lift: float) -> Transducer:
    """Insults in one clause heap up."""
    return Transducer(2, {(0, INSULT): (1, 1.0), (1, INSULT): (1, lift)})


def compose(parts: Sequence[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """The product of transducers over one input: next state and factor by state and symbol."""
    spaces = [range(p.states) for p in parts]
    index = {s: i for i, s in enumerate(product(*spaces))}
    nxt, factor = np.zeros((len(index), len(CLASSES)), np.int64), np.ones((len(index), len(CLASSES)))
    for s, i in index.items():
        for x in range(len(CLASSES)):
            got = [p.step(q, x) for p, q in zip(parts, s)]
            nxt[i, x], factor[i, x] = index[tuple(g[0] for g in got)], math.prod(g[1] for g in got)
    return nxt, factor


GRAMMAR = (_negating(0.25, 3), _reporting(0.5), _targeting(1.25), _threatening(6.0), _heaping(1.25))
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURES = 4
#: What a clause must weigh to count as matched.
MATCH = 1.0


@dataclass(frozen=True)
class Fit:
    """sample: labelled documents from which lexicon and weights are learnt, at most; the lowest by
    a hash of the id. lexicon: words, at most. support: documents of the class that a word needs.
    odds: its least log odds. surprise: the least signed root of its likelihood ratio, which chance
    does not reach. sharing: different words of the lexicon that a stem needs. neutral: no word
    beyond the lexicon that begins with a stem may stand in a larger share of all documents."""

    sample: int = 20_000
    lexicon: int = 4_000
    support: int = 4
    odds: float = 1.5
    surprise: float = 3.9
    sharing: int = 3
    neutral: float = 1e-4
    ridge: float = 1.0


@dataclass
class Grammar:
    """A lexicon of weighted insults, whole words as =word and stems as they are, the composed
    grammar, and the weights of a document's features."""

    lexicon: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [-3.0, 1.0, 0.5, 1.0])

    def reader(self):
        """word -> (symbols, weight), remembered for each word that a task has met."""
        fixed = {w: c for c, ws in ((WHOM, TARGET), (NOT, NEGATION), (SAYS, REPORT), (HURT, THREAT)) for w in ws}
        lexicon = self.lexicon

        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, bool, float]:
                if len(self) >= REMEMBER:
                    self.clear()
                w = _TRIM.sub("", word.lower())
                weight = lexicon.get("=" + w, 0.0)
                if not weight:
                    weight = max((lexicon.get(w[:k], 0.0) for k in STEMS if k <= len(w)), default=0.0)
                kind = fixed.get(w, OTHER)
                found = (kind if kind else INSULT if weight else OTHER, word[-1:] in ".,;:!?…", weight or 1.0)
                self[word] = found
                return found

        return Known()

    def features(self, texts: Iterable[str], known: dict | None = None) -> np.ndarray:
        """Of each text: 1, log of the best clause, log of the number of clauses with a match, and
        their share of all clauses. known: a reader that is kept from batch to batch."""
        nxt, factor = compose(GRAMMAR)
        nxt, factor = nxt.tolist(), factor.tolist()
        known, out = self.reader() if known is None else known, []
        for text in texts:
            read = [known[w] for w in _WORD.findall(text)]
            if not any(k in (INSULT, HURT) for k, _, _ in read):
                out.append((1.0, 0.0, 0.0, 0.0))
                continue
            state, clause, best, matched, clauses = 0, 0.0, 0.0, 0, 1
            for kind, ends, weight in read:
                if kind:
                    if kind == INSULT or kind == HURT:
                        clause += weight * factor[state][kind]
                    elif kind == WHOM:
                        clause *= factor[state][kind]
                state = nxt[state][kind]
                if ends:
                    best, matched, clauses = max(best, clause), matched + (clause >= MATCH), clauses + 1
                    state, clause = nxt[state][END], 0.0
            best, matched = max(best, clause), matched + (clause >= MATCH)
            out.append((1.0, math.log1p(best), math.log1p(matched), matched / clauses))
        return np.array(out, float).reshape(-1, FEATURES)

    def scores(self, texts: Iterable[str], known: dict | None = None) -> np.ndarray:
        z = np.clip(self.features(texts, known) @ np.array(self.weights), -30, 30)
        return 1 / (1 + np.exp(-z))


def held_out(id_col: str):
    """Whether crc32 of the id as text is divisible by 5; such rows are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights by Newton's method. All but the first are held at 0 or above, so that a match never
    makes a text less toxic: the most negative one leaves until none is."""
    free = list(range(x.shape[1]))
    while True:
        w, part = np.zeros(len(free)), x[:, free]
        keep = ridge * np.eye(len(free))
        keep[0, 0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            step = np.linalg.solve((part * (p * (1 - p) + 1e-9)[:, None]).T @ part + keep, part.T @ (y - p) - keep @ w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        worst = int(np.argmin(w[1:])) + 1 if len(free) > 1 else 0
        if not worst or w[worst] >= 0:
            out = np.zeros(x.shape[1])
            out[free] = w
            return out
        free.pop(worst)


def _bare_words(text: str) -> Column:
    """The different words of a text in lower case, without what surrounds their letters and digits."""
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 3))


def _learnt_words(rows: DataFrame, pos: int, neg: int, rule: Fit) -> dict[str, float]:
    """Words (word, log odds) that stand in the class far more often than chance makes likely."""
    seen = rows.select("_y", F.explode(_bare_words("_text")).alias("word")).groupBy("word").agg(F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("n"))
    share = (F.col("p") + F.col("n")) / (pos + neg)
    term = lambda have, want: F.when(have > 0, have * F.log(have / want)).otherwise(0.0)
    ratio = term(F.col("p"), share * pos) + term(F.col("n"), share * neg) + term(pos - F.col("p"), (1 - share) * pos) + term(neg - F.col("n"), (1 - share) * neg)
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    told = seen.where(F.col("p") >= rule.support).withColumns({"odds": odds, "surprise": F.sqrt(2 * F.greatest(ratio, F.lit(0.0)))})
    best = told.where((F.col("odds") >= rule.odds) & (F.col("surprise") >= rule.surprise)).orderBy(F.desc("surprise"), "word").limit(rule.lexicon)
    return {r["word"]: float(r["odds"]) for r in best.collect()}  # at most rule.lexicon rows


def _stems(docs: DataFrame, found: dict[str, float], text_col: str, rule: Fit) -> dict[str, float]:
    """Stems of the lexicon's words with the least odds of these. All documents are asked whether
    another word that begins so is frequent; only words with the first letters of a stem are counted."""
    held = Counter(w[:k] for w in found for k in STEMS if k <= len(w))
    stems = {s: min(o for w, o in found.items() if w.startswith(s)) for s, n in held.items() if n >= rule.sharing}
    if not stems:
        return {}
    first = sorted({s[: STEMS[0]] for s in stems})
    spread = docs.select(F.explode(_bare_words(text_col)).alias("word")).where(F.substring("word", 1, STEMS[0]).isin(first)).groupBy("word").agg(F.count("*").alias("n"))
    known = docs.sparkSession.createDataFrame([(w,) for w in found], "word string")
    cut = F.transform(F.sequence(F.lit(STEMS[0]), F.least(F.length("word"), F.lit(STEMS[-1]))), lambda k: F.col("word").substr(F.lit(1), k))
    worst = spread.join(F.broadcast(known), "word", "left_anti").select("n", F.explode(cut).alias("stem")).where(F.col("stem").isin(sorted(stems))).groupBy("stem").agg(F.max("n").alias("n")).collect()
    limit = rule.neutral * docs.count()
    return {s: o for s, o in stems.items() if s not in {r["stem"] for r in worst if r["n"] > limit}}


def fit(docs: DataFrame, labels: DataFrame, rule: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Learns from labelled rows that are not held out, at most rule.sample of them, read once.

    Null ids and labels are left out; of rows that repeat an id the least text counts, of labels
    the largest; null texts count as empty. Without labels of both classes the grammar keeps its
    default weights and an empty lexicon.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    sample = known.groupBy("_id").agg(F.max("_y").cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rule.sample)
    sample = docs.sparkSession.createDataFrame(sample.collect(), sample.schema)  # at most rule.sample ids
    plain = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("_text"))
    rows = scratch.save(plain.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_text").alias("_text")))
    totals = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        scratch.forget(rows)
        return Grammar({})
    found = _learnt_words(rows, pos, neg, rule)
    grammar = Grammar({f"={w}": o for w, o in found.items()} | _stems(plain, found, "_text", rule))
    columns = [f"f{i}" for i in range(FEATURES)]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = grammar.reader()
        for b in batches:
            yield pd.DataFrame(grammar.features(b["_text"], known), columns=columns).assign(y=b["_y"].to_numpy())
        release()

    got = rows.mapInPandas(measure, ", ".join(f"{c} double" for c in columns) + ", y int").toPandas()  # at most rule.sample rows
    scratch.forget(rows)
    got = got.sort_values([*columns, "y"], kind="stable")  # sums that no order of rows changes
    grammar.weights = _logistic(got[columns].to_numpy(), got["y"].to_numpy(float), rule.ridge).tolist()
    return grammar


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on). Null texts count as empty; the score
    depends on the text alone, so repeated rows agree; columns of these names are replaced; an
    empty table stays empty. A very long text costs time by its length, and no more memory than its words."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = grammar.reader()
        for texts in batches:
            yield pd.Series(grammar.scores(texts, known))
        known.clear()
        release()

    return docs.withColumn("score", rate(body(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def report(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of op2."""
    return scored.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), "score", "predicted")
