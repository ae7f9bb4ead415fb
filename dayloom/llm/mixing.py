"""Mixing sources to target weights by soft membership.

A classifier learned from a labelled table gives each document posteriors over domains (naive
Bayes on byte pairs, by segments of SEGMENT bytes, averaged over the text, so that a text of two
languages belongs to both). Document rates r >= least then minimise

    1/2 |S (A r - T)|^2 + ridge/2 sum_i n_i (r_i - 1)^2,   A r = sum_i n_i p_i r_i,

the distance of the expected domain token totals from the targets T, by projected gradient
steps. A step needs only the domain totals, one distributed sum of K numbers; rates are not
stored but follow from the steps' K-vectors, so that the state on the driver is steps x K
numbers whatever the corpus. No shuffle but of sums.

The domains are those of all labelled rows. Training reads a sample of these (by a hash of
doc_id): SAMPLE in expectation, but at least LEAST_ROWS of each domain, or all that it has. The
model takes 256 KB a domain.

Edge cases: null text is empty: no tokens, equal posteriors, rate 1 (or least). Labelled rows
without a domain or of more than one are left out, as are domains whose sampled texts all are of
other domains too or have no two bytes. Without labelled rows there is one domain. A target of a
domain that the model has not is an error.
Equal texts get equal rates. A very long text is read by blocks of bounded memory. Empty tables give empty tables; extra columns pass through.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.llm.common import Scratch, free_name, lean, small_batches

SAMPLE = 4000
LEAST_ROWS = 200
SEGMENT = 400
PAIRS = 1 << 16
CELLS = 1 << 20  # weights gathered at once
STEPS = 60
TOLERANCE = 5e-3  # of each domain's target, at which steps end
MISSED = 0.05  # of a domain's target, from which a fit says that it missed it
MOST_GROWTH = 16.0  # times the corpus that documents may be repeated to meet targets without dropping any
RIDGE = 1e-3
TEMPERATURE = 0.7  # default targets: shares of tokens to this power


def _pairs(raw: np.ndarray) -> np.ndarray:
    return raw[:-1].astype(np.int32) * 256 + raw[1:]


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # PAIRS x domains, log probabilities

    def posterior(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
        k = len(self.domains)
        if len(raw) < 2:
            return np.full(k, 1.0 / k)
        block, sums = SEGMENT * max(1, CELLS // (SEGMENT * k)), np.zeros(k)
        for at in range(0, len(raw) - 1, block):  # memory is that of a block, however long the text
            x = _pairs(raw[at : at + block + 1])
            z = np.add.reduceat(self.weights[x], np.arange(0, len(x), SEGMENT), axis=0)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            size = np.full(len(z), SEGMENT, np.float64)
            size[-1] = len(x) - SEGMENT * (len(z) - 1)
            sums += size @ (z / z.sum(axis=1, keepdims=True))
        return sums / (len(raw) - 1)


def fit_domains(docs: DataFrame, labelled: DataFrame, domain: str, sample: int = SAMPLE) -> DomainModel:
    """``labelled``: doc_id of the rows whose ``domain`` is taken as their label."""
    ids = labelled.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = docs.select(F.col("doc_id"), F.col(domain).cast("string").alias("domain")).where(F.col("domain").isNotNull())
    known = known.join(ids, "doc_id", "left_semi")
    sizes = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if n > sample:
        shares = docs.sparkSession.createDataFrame([(d, int((1 << 30) * min(1.0, max(sample / n, LEAST_ROWS / x)))) for d, x in sorted(sizes.items())], "__domain string, __share long")
        known = known.join(F.broadcast(shares), F.col("domain") == F.col("__domain")).where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.col("__share"))
    chosen = known.select(F.col("doc_id").alias("__id"), F.col("domain").alias("__of")).distinct()
    docs = docs.select(F.col("doc_id"), F.col("text"), F.col(domain).cast("string").alias("__d"))
    rows = docs.join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("__d") == F.col("__of")))  # bounded by ``sample`` and LEAST_ROWS
    rows = rows.select("doc_id", F.col("__d").alias("domain"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    one = rows.groupBy("text").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other").select("text", "domain")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in small_batches(batches):
            for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = sums.setdefault(d, np.zeros(PAIRS, np.int64))
                c += np.bincount(_pairs(np.frombuffer(t.encode("utf-8"), np.uint8)), minlength=PAIRS)
        for d, c in sorted(sums.items()):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], names=["domain", "pair", "n"])

    cells = one.mapInArrow(lean(count), "domain string, pair int, n long").groupBy("domain", "pair").agg(F.sum("n").alias("n")).toArrow()
    of = cells["domain"].combine_chunks().dictionary_encode()
    of = of.combine_chunks() if isinstance(of, pa.ChunkedArray) else of
    found = of.dictionary.to_pylist()
    domains = sorted(found) or ["all"]
    counts = np.full((PAIRS, len(domains)), 0.05, np.float32)
    place = np.array([domains.index(d) for d in found], np.int64)
    counts[np.asarray(cells["pair"], np.int64), place[np.asarray(of.indices)] if found else 0] += np.asarray(cells["n"], np.float32)
    counts /= counts.sum(axis=0, dtype=np.float64).astype(np.float32)
    return DomainModel(domains, np.log(counts, out=counts))


def memberships(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """Replaces the text by n_tokens (words) and posterior."""
    made = ("n_tokens", "posterior", text)
    keep = [f for f in docs.schema.fields if f.name not in made]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.FloatType()))])
    k = len(model.domains)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = b.column(len(keep)).to_pylist()
            flat = np.concatenate([model.posterior(t) for t in texts]).astype(np.float32) if texts else np.empty(0, np.float32)
            words = pa.array([len((t or "").split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], words, pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * k, pa.int32()), pa.array(flat))], names=schema.names)

    return docs.select(*[f.name for f in keep], text).mapInArrow(lean(run), schema)


@dataclass
class Mix:
    """What gives a document its rate: the steps' gradients in domain space."""

    domains: list[str]
    history: list[np.ndarray]
    rate: float
    ridge: float
    least: float
    targets: np.ndarray
    totals: np.ndarray

    def missed(self) -> dict[str, float]:
        """Domains whose expected total is off its target by more than MISSED, as a share of it."""
        off = np.abs(self.totals - self.targets) / np.maximum(self.targets, 1e-9 * max(1.0, self.targets.sum()))
        return {d: float(x) for d, x in zip(self.domains, off, strict=True) if x > MISSED}

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.full(len(p), max(1.0, self.least))
        for g in self.history:
            r = np.maximum(self.least, r - self.rate * (p @ g + self.ridge * (r - 1)))
        return r


def _columns(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(b.column("n_tokens"), np.float64), np.asarray(b.column("posterior").flatten(), np.float64).reshape(-1, k)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float] | None = None, total: float | None = None, least: float = 0.0, steps: int = STEPS, most_growth: float = MOST_GROWTH) -> Mix:
    """``targets``: wished shares of tokens by domain (default: natural shares to the power
    TEMPERATURE). ``total``: wished tokens (default: as many as there are). With least >= 1 every
    document stays and the total is raised so that no domain has to shrink; targets that take more
    than ``most_growth`` times the corpus are an error. Targets that the bound on rates or the number
    of steps keeps out of reach are a warning, and in ``Mix.missed``."""
    k = len(domains)
    unknown = sorted(set(targets or ()) - set(domains))
    if unknown:
        raise ValueError(f"targets of domains that no labelled text has: {', '.join(unknown)}")

    def summed(function) -> np.ndarray:
        """Sum over all rows of a vector that function makes of (n, p)."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                if b.num_rows:
                    v = function(*_columns(b, k))
                    out = v if out is None else out + v
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], names=["i", "v"])

        rows = members.select("n_tokens", "posterior").mapInArrow(lean(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        found = np.zeros(max([r.i for r in rows], default=-1) + 1)
        for r in rows:
            found[r.i] = r.v
        return found

    first = summed(lambda n, p: np.concatenate([n @ p, ((p * n[:, None]).T @ p).ravel()]))
    if not len(first) or first[:k].sum() == 0:
        return Mix(domains, [], 0.0, RIDGE, least, np.zeros(k), np.zeros(k))
    natural, gram = first[:k], first[k:].reshape(k, k)
    share = (natural / natural.sum()) ** TEMPERATURE if targets is None else np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    share = share / share.sum()
    if total is None:
        total = natural.sum()
        if least >= 1:
            there = share > 0
            total = max(total, float((natural[there] / share[there]).max()) * least)
            if total > most_growth * natural.sum():
                raise ValueError(f"no document may go, and these targets take {total / natural.sum():.0f} times the corpus (most_growth: {most_growth:g})")
    wished = share * total
    scale = 1 / np.maximum(np.diag(gram), 1e-9 * gram.trace())  # S^2
    root = np.sqrt(scale)
    step = 1 / (np.linalg.norm(root[:, None] * gram * root[None, :], 2) + RIDGE)
    mix = Mix(domains, [], step, RIDGE, least, wished, natural)
    totals = natural * max(1.0, least)
    for _ in range(steps):
        if (np.abs(totals - wished) <= TOLERANCE * wished + 1e-6 * total).all():
            break
        mix.history.append(scale * (totals - wished))
        new = summed(lambda n, p: (n * mix.rates(p)) @ p)
        still = (np.abs(new - totals) <= 1e-3 * TOLERANCE * np.maximum(totals, wished)).all()
        totals = new
        if still:
            break
    mix.totals = totals
    if mix.missed():
        warnings.warn("targets missed by shares of " + ", ".join(f"{d}: {x:.2g}" for d, x in mix.missed().items()), stacklevel=2)
    return mix


def with_rates(members: DataFrame, mix: Mix) -> DataFrame:
    """Adds rate, and copies: its whole part, and one more with the chance of the rest, drawn by a
    hash of doc_id."""
    keep = [f for f in members.schema.fields if f.name not in ("rate", "copies")]
    schema = T.StructType([*keep, T.StructField("rate", T.DoubleType())])
    k = len(mix.domains)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mix.rates(_columns(b, k)[1]))], names=schema.names)

    out = members.select(*[f.name for f in keep]).mapInArrow(lean(run), schema)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def mix_documents(docs: DataFrame, labelled: DataFrame, domain: str = "lang", least: float = 1.0, **wish) -> DataFrame:
    """The documents, each as often as its rate says. One more pass over the texts makes the
    posteriors again, which spares a join that would move every text."""
    model = fit_domains(docs, labelled, domain)
    scratch = Scratch(docs.sparkSession)
    members = scratch.put(memberships(docs.select("doc_id", "text"), model), "members")
    mix = fit_rates(members, model.domains, least=least, **wish)
    scratch.drop(members)
    schema, where = docs.schema, docs.columns.index("text")
    rate, copy = free_name(docs, "__rate"), free_name(docs, "__copy")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rates = mix.rates(np.stack([model.posterior(t).astype(np.float32).astype(np.float64) for t in b.column(where).to_pylist()])) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates)], names=[*schema.names, rate])

    out = docs.mapInArrow(lean(run), T.StructType([*schema.fields, T.StructField(rate, T.DoubleType())]))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("long")
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(copies, F.lit(0).cast("long"))))).where(copies > 0).select(*docs.columns)


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    model = fit_domains(docs, labels, "lang")
    members = Scratch(spark).put(memberships(docs.select("doc_id", "text"), model), "members")
    mix = fit_rates(members, model.domains)
    domains = F.array(*[F.lit(d) for d in model.domains])
    return with_rates(members, mix).select("doc_id", "n_tokens", F.element_at(domains, F.array_position("posterior", F.array_max("posterior")).cast("int")).alias("domain"), "posterior", "rate", "copies")
