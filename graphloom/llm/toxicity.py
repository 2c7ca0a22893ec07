"""Toxicity by a weighted finite-state pattern grammar.

Lexicon.  Insults are word stems with weights, learned from labelled texts: a stem
enters when the texts that hold it are toxic far beyond chance (a log-likelihood
ratio test and a least share).  The shortest such stem stands for its longer ones, spelled out
as far as that loses next to none of its texts.  A few built-in words give a start where labels are scarce.  Function words for threats, targets,
negation and reported speech are fixed lists.

Grammar.  Words and marks of a sentence become tags.  One transducer each reads them and scales what passes:
an insult weighs in full only with a target close to it; a threat weighs little by itself, and in full at the target that follows it,
if intent came before; negation lowers what the next words hold in the same clause; reported speech lowers
what a verb of saying introduces, to the end of the quotation or sentence.  These are composed into one machine, so a sentence is
scored by its matched patterns and not by isolated words.  What is said of a clause after it (`you moron, he said`, `morons like you`)
takes a second machine, which reads the same tags backward; their factors multiply.

Scan.  An Aho-Corasick automaton finds insults and threats in the whole text; only
sentences around a hit are read word by word.  A text's evidence, the sum over its sentences, becomes
a probability by a logistic curve fitted to the same labelled texts around a stated prior.

Learning uses ``FIT_ROWS`` labelled rows at most, chosen by a hash of the id, never
those whose ``crc32(doc_id)`` modulo 3 is 1.  Of near copies among them the one with the least id counts.  A score depends on the text alone.

Defined results.  Null and empty texts have no evidence and get the curve's lowest score.  Labels that are null
or lack a document are passed over; without labels the built-in words and the prior decide.  Repeated rows score alike,
and long texts are read whole.  An empty table gives an empty result.  Extra columns are ignored by the query and kept by the filter,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, stored, table
from .ngram_join import sets

#: Labelled rows that fitting reads at most.
FIT_ROWS = 6000
#: Lengths of stems that are tried, besides whole words.
STEMS = range(3, 9)
#: Stems kept at most, the strongest first.
LEXICON = 2000
#: The least log-likelihood ratio and toxic share of a stem's texts.
LEAST_RATIO, LEAST_SHARE = 24.0, 0.7
THRESHOLD = 0.7
#: Prior of the curve: intercept and slope over a text's evidence, and their spread.
PRIOR, SPREAD = (-4.0, 4.0), 1.5

# Built-in words by tag.
INSULTS = "idiot moron scum trash loser stupid pathetic worthless disgusting clown imbecile vermin".split()
#: Verbs of harm, as stems that endings of up to ``ENDING`` letters may follow.
THREATS = "kill murder hurt destroy strangl stab shoot töte umbring erwürg tuer frapp étrangl mata golpea estrangul".split()
ENDING = 3
INTENTS = "will would shall should must gonna going want wants wanna hope let i'll we'll they'll he'll she'll werde werden wird sollte vais va vont veux voy va vamos quiero".split()
TARGETS = "you your yours u yourself they them their he him his she her people du dich dir dein ihr euch sie tu toi te ton vous ils elles tú ti usted ustedes ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't nobody nicht kein keine nie niemals pas jamais nunca jamás".split()
REPORTS = "said says wrote writes called calls claimed claims quoted quote shouted yelled sagte sagt schrieb dit écrit disait dijo dice escribió".split()
INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, BREAK, QUOTE, OTHER = "insult", "threat", "target", "negation", "report", "intent", "break", "quote", "other"
TAGS = (INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, BREAK, QUOTE, OTHER)
#: Weights and factors: a threat's weight; an insult and a threat by themselves; with a target; a threat with a target but without intent; after a negation; in reported speech.
HARM, BARE, BARE_THREAT, AIMED, UNMEANT, NEGATED, REPORTED = 0.8, 0.8, 0.15, 1.25, 0.3, 0.4, 0.5
#: Words over which a target before an insult, one after it, a target after a threat, intent and negation reach.
BEFORE, AFTER, OBJECT, MEANT, DENIED = 4, 2, 3, 4, 4

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[,;:]|[\"“”„«»]")
_SENTENCE = re.compile(r"[.!?]+(?![.!?\"“”»])|\n")


class Machine(NamedTuple):
    """A deterministic weighted transducer over tags: ``arcs[state, tag] = (next state, factor)``."""

    start: object
    arcs: dict


def machine(start, states, step) -> Machine:
    return Machine(start, {(s, t): step(s, t) for s in states for t in TAGS})


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines over the same tags: states pair up, factors multiply.  Only reachable states are built."""
    start = (a.start, b.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        s = todo.pop()
        for t in TAGS:
            (x, f), (y, g) = a.arcs[s[0], t], b.arcs[s[1], t]
            arcs[s, t] = ((x, y), f * g)
            if (x, y) not in seen:
                seen.add((x, y))
                todo.append((x, y))
    return Machine(start, arcs)


def forward() -> Machine:
    """What comes before decides: targets, threats with their objects, negation and the verb of saying."""
    # Insults and threats pass as they are, and a target, at which a threat weighs; everything else weighs nothing.
    clause = machine(0, [0], lambda s, t: (0, {INSULT: BARE, THREAT: 1.0, TARGET: 1.0}.get(t, 0.0)))
    target = machine(0, range(BEFORE + 1), lambda s, t: (BEFORE if t == TARGET else 0 if t == QUOTE else max(0, s - 1), AIMED if s and t == INSULT else 1.0))

    def threaten(s: tuple[int, int, bool], t: str) -> tuple[tuple[int, int, bool], float]:
        meant, waiting, earnest = s
        if t == TARGET and waiting:
            return (max(0, meant - 1), 0, False), 1.0 if earnest else UNMEANT
        if t in (BREAK, QUOTE):
            return (0, 0, False), 1.0
        if t == THREAT:
            return (max(0, meant - 1), OBJECT, meant > 0), BARE_THREAT
        after = waiting > 1
        return (MEANT if t == INTENT else max(0, meant - 1), max(0, waiting - 1), earnest and after), 0.0 if t == TARGET else 1.0

    threat = machine((0, 0, False), [(m, w, e) for m in range(MEANT + 1) for w in range(OBJECT + 1) for e in (False, True)], threaten)
    negation = machine(0, range(DENIED + 1), lambda s, t: (DENIED if t == NEGATION else 0 if t in (BREAK, QUOTE) else max(0, s - 1), NEGATED if s and t in (INSULT, THREAT, TARGET) else 1.0))

    def report(s: str, t: str) -> tuple[str, float]:
        low = REPORTED if s != "none" else 1.0
        if t == REPORT and s == "none":
            return "verb", 1.0
        if t == QUOTE:
            return {"verb": "quoted", "quoted": "none"}.get(s, s), low
        return s, low

    return reduce(compose, [clause, target, threat, negation, machine("none", ["none", "verb", "quoted"], report)])


def backward() -> Machine:
    """What comes after decides, read from the end: a target just after an insult, and a verb of saying that follows a clause."""
    target = machine(0, range(AFTER + 1), lambda s, t: (AFTER if t == TARGET else 0 if t in (BREAK, QUOTE) else max(0, s - 1), AIMED if s and t == INSULT else 1.0))

    def report(s: str, t: str) -> tuple[str, float]:
        if t == REPORT:
            return "verb", 1.0
        if t == BREAK:
            return {"verb": "clause", "clause": "none"}.get(s, s), 1.0
        if t == QUOTE:
            return {"verb": "quoted", "clause": "quoted", "quoted": "none"}.get(s, s), 1.0
        return s, REPORTED if s in ("clause", "quoted") else 1.0

    return compose(target, machine("none", ["none", "verb", "clause", "quoted"], report))


def numbered(m: Machine) -> tuple[int, dict]:
    number = {s: i for i, s in enumerate({s for s, _ in m.arcs})}
    return number[m.start], {(number[s], t): (number[n], f) for (s, t), (n, f) in m.arcs.items()}


class Grammar:
    """The composed machines with their lexicon, ready to score texts."""

    def __init__(self, lexicon: dict[str, float]):
        """Entries ending in ``$`` are whole words, others stems."""
        self.lexicon = lexicon
        self.weights: dict[str, float] = {w + "$": 1.0 for w in INSULTS} | lexicon
        self.tags = {w: tag for words, tag in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (INTENTS, INTENT)) for w in words} | dict.fromkeys(",;:", BREAK) | dict.fromkeys('"“”„«»', QUOTE)
        self.automaton = ahocorasick.Automaton()
        for key in [*(e.rstrip("$") for e in self.weights), *THREATS]:
            self.automaton.add_word(key, len(key))
        self.automaton.make_automaton()
        self.forward, self.backward = numbered(forward()), numbered(backward())
        self.sizes = sorted({len(e) for e in self.weights if not e.endswith("$")})
        self.known: dict[str, tuple[str, float]] = {}

    def weigh(self, word: str) -> tuple[str, float]:
        """Tag and weight of a lower-case word or mark; of a word with an apostrophe the parts count if the whole says nothing."""
        best = self.weights.get(word + "$", 0.0)
        for n in self.sizes:
            if n > len(word):
                break
            best = max(best, self.weights.get(word[:n], 0.0))
        if best:
            return INSULT, best
        if (tag := self.tags.get(word)) is not None:
            return tag, HARM if tag == TARGET else 0.0
        if any(word.startswith(x) and len(word) <= len(x) + ENDING for x in THREATS):
            return THREAT, HARM
        if "'" in word:
            found = [self.weigh(x) for x in word.split("'")]
            return next((f for f in found if f[0] != OTHER), (OTHER, 0.0))
        return OTHER, 0.0

    def sentence(self, text: str) -> float:
        read = []
        for m in _TOKEN.finditer(text):
            word = m[0]
            if (tagged := self.known.get(word)) is None:
                tagged = self.weigh(word)
                if len(self.known) < 50_000 and len(word) <= 32:
                    self.known[word] = tagged
            read.append(tagged)
        state, table = self.backward
        after = []
        for tag, _ in reversed(read):
            state, factor = table[state, tag]
            after.append(factor)
        state, table = self.forward
        total = 0.0
        for (tag, weight), late in zip(read, reversed(after), strict=True):
            state, factor = table[state, tag]
            # An insult is aimed once, from whichever side.
            total += weight * (min(factor * late, BARE * AIMED) if tag == INSULT else factor * late)
        return total

    def evidence(self, text: str | None) -> float:
        """Summed scores of the sentences of a whole text."""
        if not text:
            return 0.0
        low = text.lower()
        total, done = 0.0, 0
        for end, size in self.automaton.iter(low):
            at = end - size + 1
            if at < done or at and low[at - 1].isalnum():
                continue
            # The sentence around the hit, read once: from the last end before it to the next.
            for m in _SENTENCE.finditer(low, done, at):
                done = m.end()
            stop = _SENTENCE.search(low, at)
            total += self.sentence(low[done : stop.start() if stop else len(low)])
            done = stop.end() if stop else len(low)
        return total


class Model(NamedTuple):
    lexicon: dict[str, float]
    intercept: float
    slope: float

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.intercept + self.slope * evidence))))


def stems(text: str | None) -> set[str]:
    out = set()
    for w in set(_WORD.findall((text or "").lower())):
        out.add(w + "$")
        out.update(w[:n] for n in STEMS if n < len(w))
    return out


def count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (toxic if label else clean).update(stems(text))
    # A stem without a toxic text in this partition still counts against itself elsewhere.
    keys = [k for k in toxic.keys() | clean.keys()]
    yield pa.RecordBatch.from_pydict({"stem": pa.array(keys, pa.string()), "toxic": pa.array([toxic[k] for k in keys], pa.int64()), "clean": pa.array([clean[k] for k in keys], pa.int64())})


def spelled_out(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """The shortest stems, each as long as nearly all of its toxic texts allow, with the squared toxic share as weight."""
    out = {}
    for stem in counts:
        if any(stem[:k] in counts for k in range(1, len(stem))):
            continue
        longer = [s for s in counts if s.startswith(stem) and counts[s][0] >= 0.97 * counts[stem][0]]
        best = max(longer, key=lambda s: (len(s), s))
        toxic, clean = counts[best]
        out[best] = (toxic / (toxic + clean + 1.0)) ** 2
    return out


def least_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least shingle hash of each text: near copies mostly share it."""
    for batch in batches:
        least = [int(s[0].view(np.int64)) if len(s) else 0 for s in sets(batch.column("text"))]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": batch.column("text"), "toxic": batch.column("toxic"), "least": pa.array(least, pa.int64())})


def fit_curve(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Intercept and slope with the greatest posterior, by Newton steps."""
    prior = np.array(PRIOR)
    w = prior.copy()
    x = np.stack([np.ones_like(evidence), np.minimum(evidence, 12.0)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - label) + (w - prior) / SPREAD**2
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) / SPREAD**2
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.5))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """Lexicon and curve from at most ``most`` labelled rows."""
    marked = labels.where("toxic is not null and doc_id is not null").where(crc_mod(F.col("doc_id"), 3) != 1)
    chosen = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = stored(
        docs.where(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(least_shingle, "doc_id long, text string, toxic int, least long"), "labelled"
    ).groupBy("least", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("first.doc_id", "first.text", "toxic")
    totals = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, toxic = totals[0], totals[1] or 0
    if not n or not toxic:
        return Model({}, *PRIOR)
    base = max(toxic / n, 1e-3)
    a, b = F.col("toxic"), F.col("clean")
    ratio = 2 * (a * F.log(a / ((a + b) * base)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - base)))).otherwise(0.0))
    found = (
        sample.select("text", "toxic").mapInArrow(count_stems, "stem string, toxic long, clean long")
        .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((a > 0) & (a >= LEAST_SHARE * (a + b)) & (ratio >= LEAST_RATIO))
        .orderBy(ratio.desc(), "stem").limit(LEXICON).collect()
    )
    kept = spelled_out({r["stem"]: (r["toxic"], r["clean"]) for r in found})
    rules = Grammar(kept)
    rows = sample.select("text", "toxic").mapInArrow(lambda it: _evidence(it, rules.lexicon), "evidence double, toxic int").toArrow()
    intercept, slope = fit_curve(rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(float))
    return Model(kept, intercept, slope)


def _evidence(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float]) -> Iterator[pa.RecordBatch]:
    rules = Grammar(lexicon)
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"evidence": pa.array([rules.evidence(x.as_py()) for x in batch.column("text")], pa.float64()), "toxic": batch.column("toxic")})


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Grammar(model.lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "score": pa.array([model.score(rules.evidence(x.as_py())) for x in batch.column("text")], pa.float64()),
            })

    rows = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows predicted toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Grammar(model.lexicon)
        for batch in batches:
            yield batch.filter(pa.array([model.score(rules.evidence(x.as_py())) < THRESHOLD for x in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
