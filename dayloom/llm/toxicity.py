"""Toxicity: a weighted finite-state pattern grammar over clauses.

Small transducers read a clause's tokens from left to right and are composed into one machine, whose
states are built as they are met; a clause weighs what its heaviest accepted path does.

* lexicon: a trie of whole words and word beginnings learned from the labelled table writes
  ``insult`` (weighted by its log odds of a toxic document); word lists write ``negation``,
  ``report``, ``target`` and ``threat``; all other words are ``word``;
* choice: picks one insult (accepted), or a threat and a target in either order (accepted as a
  ``menace``, without any insult); what it does not pick it passes on as context;
* negation: in force for the next SCOPE tokens, up to a conjunction, on the picked insult or menace;
* reported speech: in force from its verb to the end of the clause;
* target: raises or lowers a picked insult, whether read before or after it;
* threat: raises or lowers a picked insult behind it.

The context arcs' weights are learned too: how much more, or less, often a clause with an insult is in
a toxic document when the arc is taken. Where the labels show no difference, or no clean text has an
insult to compare with, the arc weighs nothing, so a chance "no" does not excuse an insult. The weight
of a menace is the log odds of the texts that have one and no insult, drawn to the prior MENACE where
there are few. A document scores by its heaviest clause.

An Aho-Corasick automaton finds the clauses that hold an insult or a threat at all; only those
are run through the grammar. Row-wise, no shuffle of texts. Training reads a bounded sample of
labelled rows (``SAMPLE`` expected, chosen by a hash of doc_id), which is small enough to
broadcast by that bound; arcs are counted, compared and weighed in Spark, all of them.

Edge cases: null text is empty text; a text without insults and threats gets the base score. Labels that
are null or disagree, of one document or of equal texts, are left out. Without toxic labels every score
is the base score 0. Equal texts get equal scores; an empty table gives an empty table; extra columns
pass through unless they clash with the result's.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import pairwise
from math import exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.llm.common import Scratch, bit_filter, passes, small_batches
from dayloom.llm.quality import held_out, trusted

THRESHOLD = 0.7
SAMPLE = 20_000  # labelled rows to learn from, in expectation
PREFIXES = (4, 5, 6)
LEAST_DOCS = 3  # different contexts, and texts, that an arc must be seen in
LEAST_ODDS = 1.9  # log odds of an insult arc, with half a context added to either side
SEEN_CLEAN_ODDS = 4.0  # and of an arc that clean texts have too
VARIED = 0.35  # least share of different contexts among the texts of an arc
MENACE = 1.0  # weight of a threat to a target that the labels say nothing about
SCOPE = 5  # tokens that a negation governs

# Context word lists of the grammar, in English, French, German and Spanish
NEGATION = "not no never n't without ne pas jamais sans nicht kein keine nie ohne nunca sin ni".split()
REPORTED = "said says wrote writes quoted called claims reported dit écrit appelé sagte schrieb nannte dijo escribió llamó".split()
TARGET = "you your he she they them him her u vous tu ton votre ils elle du dich dein sie ihr tú usted ustedes ellos ella".split()
THREAT = "kill hurt beat destroy die punch burn tuer frapper mourir töten schlagen sterben matar golpear morir".split()
CONJUNCTIONS = "and but or et mais ou und aber oder y pero o".split()
SYMBOLS = {w: k for k, words in (("conjunction", CONJUNCTIONS), ("threat", THREAT), ("target", TARGET), ("report", REPORTED), ("negation", NEGATION)) for w in words}
STATES = ("negated", "reported", "targeted", "threat")  # labels of the context arcs
PICKED = ("insult", "menace")

TOKEN = re.compile(r"\w+(?:['’]\w+)?")
BOUND = re.compile(r"[.!?;:\n\r|]")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def arcs_of(words: Iterable[str]) -> set[str]:
    """Whole words as ``w$``, beginnings as ``w``."""
    out = set()
    for w in words:
        out.add(w + "$")
        out.update(w[:n] for n in PREFIXES if len(w) > n)
    return out


class Transducer:
    """(state, symbol) -> arcs (next state, symbol written, label); without one the state stays and
    the symbol passes."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol: str) -> Sequence[tuple]:
        return self.arcs.get((state, symbol)) or ((state, symbol, None),)


ACCEPTED = ("insulted", "menaced")
CHOICE = Transducer("none", {
    ("none", "insult"): (("none", "word", None), ("insulted", "insult", "insult")),
    ("none", "threat"): (("none", "threat", None), ("threatened", "menace", None)),
    ("none", "target"): (("none", "target", None), ("aimed", "target", None)),
    ("threatened", "target"): (("threatened", "target", None), ("menaced", "target", "menace")),
    ("aimed", "threat"): (("aimed", "threat", None), ("menaced", "menace", "menace")),
    **{(state, "insult"): ((state, "word", None),) for state in ("insulted", "threatened", "aimed", "menaced")},
})
NEGATED = Transducer(0, {
    **{(left, "negation"): ((SCOPE, "word", None),) for left in range(SCOPE + 1)},
    **{(left, symbol): ((left - 1, symbol, None),) for left in range(1, SCOPE + 1) for symbol in ("word", "target", "threat", "report")},
    **{(left, symbol): ((left - 1, symbol, "negated"),) for left in range(1, SCOPE + 1) for symbol in PICKED},
    **{(left, "conjunction"): ((0, "word", None),) for left in range(SCOPE + 1)},
})
REPORTING = Transducer(False, {(False, "report"): ((True, "word", None),), **{(True, symbol): ((True, symbol, "reported"),) for symbol in PICKED}})
TARGETED = Transducer("none", {("none", "target"): (("seen", "word", None),), ("seen", "insult"): (("done", "insult", "targeted"),), ("none", "insult"): (("waits", "insult", None),), ("waits", "target"): (("done", "word", "targeted"),)})
THREATENING = Transducer(False, {(False, "threat"): ((True, "word", None),), (True, "insult"): ((True, "insult", "threat"),)})


class Composed:
    """Transducers in a row: each reads what the one before writes. The arcs of a state are put
    together when it is first met."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start, self.known = parts, tuple(p.start for p in parts), {}

    def step(self, state: tuple, symbol: str) -> list[tuple[tuple, tuple[str, ...]]]:
        """(next state, labels of the arcs taken)."""
        found = self.known.get((state, symbol))
        if found is None:
            paths = [((), symbol, ())]
            for part, own in zip(self.parts, state, strict=True):
                paths = [((*states, to), out, (*labels, label) if label else labels) for states, read, labels in paths for to, out, label in part.step(own, read)]
            found = self.known[state, symbol] = [(states, labels) for states, _, labels in paths]
        return found


@dataclass
class Grammar:
    insults: dict[str, float] = field(default_factory=dict)
    context: list[float] = field(default_factory=lambda: [0.0] * len(STATES))
    base: float = -6.0
    menace: float | None = MENACE  # of threat and target; None: the path is closed
    machine: Composed = field(default_factory=lambda: Composed(CHOICE, NEGATED, REPORTING, TARGETED, THREATENING), repr=False, compare=False)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in THREAT if self.menace is not None else ():
            a.add_word(w, w + "$")
        for arc in self.insults:
            a.add_word(arc.removesuffix("$"), arc)
        if len(a):
            a.make_automaton()
        return a

    def insult(self, word: str) -> float | None:
        """Weight of the heaviest accepting path of the insult transducer."""
        found = [x for x in (self.insults.get(word + "$"), *(self.insults.get(word[:n]) for n in PREFIXES if len(word) > n)) if x is not None]
        return max(found) if found else None

    def read(self, words: list[str]) -> Iterator[tuple[str, float]]:
        """The lexicon: a symbol for each word, and an insult's weight."""
        for w in words:
            x = self.insult(w)
            yield ("insult", x) if x is not None else ("negation" if w.endswith(("n't", "n’t")) else SYMBOLS.get(w, "word"), 0.0)

    def paths(self, words: list[str]) -> dict[str, tuple[float, tuple[bool, ...]]]:
        """The heaviest accepted path by what it picks (insult or menace): weight, context arcs taken."""
        read = list(self.read(words))
        said = {symbol for symbol, _ in read}
        if "insult" not in said and not (self.menace is not None and {"threat", "target"} <= said):
            return {}
        by_label = dict(zip(STATES, self.context, strict=True)) | {"menace": self.menace if self.menace is not None else -1e9}
        best: dict[tuple, tuple[float, tuple[str, ...]]] = {self.machine.start: (0.0, ())}
        for symbol, x in read:
            new: dict[tuple, tuple[float, tuple[str, ...]]] = {}
            for state, (weight, taken) in best.items():
                for to, labels in self.machine.step(state, symbol):
                    w = weight + sum(x if k == "insult" else by_label[k] for k in labels) if labels else weight
                    if to not in new or w > new[to][0]:
                        new[to] = (w, taken + labels)
            best = new
        found: dict[str, tuple[float, tuple[bool, ...]]] = {}
        for state, (weight, taken) in best.items():
            kind = "insult" if state[0] == "insulted" else "menace"
            if state[0] in ACCEPTED and (kind not in found or weight > found[kind][0]):
                found[kind] = (weight, tuple(k in taken for k in STATES))
        return found

    def clause(self, words: list[str]) -> tuple[float, tuple[bool, ...]] | None:
        """Weight and context arcs of the heaviest path; None without any."""
        return max(self.paths(words).values(), key=lambda f: f[0], default=None)

    def weigh(self, text: str, automaton=None) -> tuple[float, str]:
        """Weight of the heaviest clause (the base weight if no path accepts) and that clause."""
        low = text.lower()
        if not self.insults and self.menace is None:
            return self.base, ""
        best, said, until = self.base, "", 0
        for end, arc in (automaton or self.automaton()).iter(low):
            start = end - len(arc.removesuffix("$")) + 1
            if end < until or (start and (low[start - 1].isalnum() or low[start - 1] == "_")):
                continue
            left = until  # the end of the last clause that was read
            for m in BOUND.finditer(low, until, max(until, start)):
                left = m.end()
            right = BOUND.search(low, end + 1)
            until = right.start() if right else len(low)
            found = self.clause(TOKEN.findall(low[left:until]))
            if found and found[0] > best:
                best, said = found[0], low[left:until].strip()
        return best, said

    def score(self, text: str | None, automaton=None) -> float:
        return 1 / (1 + exp(-max(-30.0, min(30.0, self.weigh(text or "", automaton)[0]))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, sample: int = SAMPLE) -> DataFrame:
    """Distinct labelled texts of the learning folds: about ``sample`` rows by a hash of doc_id.
    The ids are broadcast; their number is bounded by ``sample``."""
    rows = trusted(labels, label, folds, fold)
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    ids = rows.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y"))
    found = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select(F.coalesce(F.col("text"), F.lit("")).alias("text"), "y")
    return found.groupBy("text").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")


def fit_grammar(sample: DataFrame) -> Grammar:
    """``sample``: text and y (0 or 1), read twice; its size is bounded by the caller."""
    sample = sample.cache()

    def contexts(known):
        """Arcs of a text (of those that a bit filter passes, if given; then once a batch, by context)
        with the words they stand between."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches):
                seen = set()
                for t in b.column(0).to_pylist():
                    words = ["", *tokens(t), ""]
                    # the least hash of two words in a row: near copies of a text mostly share it
                    one = 0 if known else min(xxhash.xxh3_64_intdigest(f"{v} {w}") for v, w in pairwise(words)) >> 1
                    for k in range(1, len(words) - 1):
                        seen.add((words[k], f"{words[k - 1]} {words[k]} {words[k + 1]}", one))
                rows = [(arc, context, one) for word, context, one in seen for arc in arcs_of((word,))]
                at = np.array([xxhash.xxh3_64_intdigest(r[0]) >> 1 for r in rows], np.int64)
                if known:
                    keep = passes(known.value, at)
                    rows, at = [r for r, ok in zip(rows, keep, strict=True) if ok], at[keep]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(at), pa.array([xxhash.xxh3_64_intdigest(r[1]) >> 1 for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["arc", "at", "context", "doc"])

        return run

    def counted(y: int, known=None) -> DataFrame:
        rows = sample.where(F.col("y") == y).select("text").mapInArrow(contexts(known), "arc string, at long, context long, doc long")
        return rows.groupBy("arc", "at").agg(F.least(F.count_distinct("context"), F.count_distinct("doc")).alias("n"), F.count_distinct("doc").alias("docs")) if known is None else rows.groupBy("arc").agg(F.count_distinct("context").alias("clean"))

    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not ones or ones == n:
        sample.unpersist()
        return Grammar(base=-30.0 if not ones else 30.0, menace=None)
    # an arc counts once a context and once a text and its near copies: neither the words of a text that
    # was copied with small changes gather weight, nor a word that one long text repeats
    scratch = Scratch(sample.sparkSession)
    often = scratch.put(counted(1).where((F.col("n") >= LEAST_DOCS) & (F.col("n") >= VARIED * F.col("docs"))), "arcs")
    both = often.join(counted(0, bit_filter(often.select("at"))), "arc", "left").withColumn("seen", F.coalesce("clean", F.lit(0)))
    both = both.withColumn("odds", F.log((F.col("n") + 0.5) / (F.col("seen") + 0.5)))
    both = both.where(F.col("odds") >= F.when(F.col("seen") > 0, SEEN_CLEAN_ODDS).otherwise(LEAST_ODDS))
    grammar = Grammar({r.arc: r.odds for r in both.select("arc", "odds").orderBy("arc").collect()})  # as many as a sample of SAMPLE rows has
    scratch.drop(often)

    def clauses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen, menaced = set(), False
                for part in BOUND.split(t.lower()):
                    paths = grammar.paths(TOKEN.findall(part))
                    menaced = menaced or ("menace" in paths and not any(paths["menace"][1][:2]))
                    if "insult" in paths:
                        seen.add(paths["insult"][1])
                states = [sum(1 << k for k, on in enumerate(s) if on) for s in seen]
                out += [(s, y) for s in states] or [(-2 if menaced else -1, y)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32())], names=["state", "y"])

    seen = sample.mapInArrow(clauses, "state int, y int").groupBy("state").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).collect()
    sample.unpersist()
    by = {r.state: (r.p, r.q) for r in seen}
    if -1 in by:
        grammar.base = min(-0.5, log((by[-1][0] + 0.5) / (by[-1][1] + 0.5)))
    p, q = by.get(-2, (0, 0))  # texts with a plain threat to a target and no insult
    grammar.menace = max(-6.0, min(6.0, log((p + 0.5 * exp(MENACE)) / (q + 0.5))))
    for k in range(len(STATES)):
        on, off = [[sum(v[j] for s, v in by.items() if s >= 0 and bool(s >> k & 1) == side) for j in (0, 1)] for side in (True, False)]
        if sum(on) >= 10:
            grammar.context[k] = max(-6.0, min(6.0, log((on[0] + 1) / (on[1] + 1)) - log((off[0] + 1) / (off[1] + 1))))
            if on[1] == off[1] == 0:
                grammar.context[k] = 0.0
    return grammar


def score_documents(df: DataFrame, grammar: Grammar, text: str = "text", out: str = "score", clause: str = "clause") -> DataFrame:
    """Adds the score and the heaviest clause."""
    keep = [f for f in df.schema.fields if f.name not in (out, clause)]
    schema, where = T.StructType([*keep, T.StructField(out, T.DoubleType()), T.StructField(clause, T.StringType())]), [f.name for f in keep].index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = grammar.automaton()
        for b in small_batches(batches):
            found = [grammar.weigh(t or "", automaton) for t in b.column(where).to_pylist()]
            scores = [1 / (1 + exp(-max(-30.0, min(30.0, w)))) for w, _ in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([c for _, c in found], pa.string())], names=schema.names)

    return df.select(*[f.name for f in keep]).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    grammar = fit_grammar(labelled_sample(docs, labels, "toxic", 3, 1))
    out = score_documents(docs, grammar)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
