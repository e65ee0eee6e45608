"""Mixing documents to target token weights with soft domain membership.

A classifier (multinomial naive Bayes on hashed words), fitted to a bounded sample of the rows that the labels table
lists, predicts each document's posterior over domains; long documents' posteriors are tempered, so membership is soft.
Expected tokens of domain d are E_d = sum of rate * tokens * posterior_d. Projected gradient steps on the rates,
preconditioned by tokens and by the domains' present totals, minimise the weighted squares of E - target; each step starts
a little ahead of the last rates, in the direction that they moved (Nesterov's momentum, begun anew where squares grew):

    rate <- max(least, ahead - sum over d of posterior_d * (E_d(ahead) - T_d) / present_d)

The rates need not be kept between steps: a rate follows from its posterior and the short history of step vectors, so
each step is one aggregation over a narrow table, and only the totals reach the driver. Steps end when E is within
TOLERANCE of the targets, or moves by less than STILL: targets may be out of reach, as rates have a least value. After
STEPS without either there is a warning, and ``converged`` is false. Tokens are words here; they stand for the packer's
ids, whose number for each word hardly differs between documents of one domain.

Defined cases: a null or empty text has no tokens (posterior = prior, does not count in E; such rows have rates and copies
like others); equal rows have equal rates and copies; a null doc_id is a key like others; no labelled rows, or no rows: one
domain; a null domain of a labelled row is a domain of its own name, ``(none)``; other columns, whatever their names, come
through ``mix`` unchanged.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, SLOTS, MOST_DOMAINS = 10_000, 1 << 15, 32
#: Words whose evidence a posterior takes at most; more words share that weight.
EVIDENCE = 8.0
#: Most steps; shares of all tokens that E may miss its targets by, and that it may move by when it has settled.
STEPS, TOLERANCE, STILL = 60, 1e-6, 2e-6
#: Default targets: present shares to this power, normalised.
FLATTEN = 0.7


@dataclass
class DomainModel:
    domains: list[str]
    prior: np.ndarray
    weight: np.ndarray = field(repr=False)  # (SLOTS, domains) log probabilities

    def posterior(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and (rows, domains) probabilities; a few texts at a time, as a word takes a row of numbers."""
        whole = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [self._posterior(b.column("text")) for b in common.slices(iter([whole]), "text", 1 << 19)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros((0, len(self.domains)))
        return np.concatenate([n for n, _ in parts]), np.concatenate([p for _, p in parts])

    def _posterior(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offs, words = common.split_words(texts, lower=True)
        lens = np.diff(offs)
        slot = (common.hash_words(words) % np.uint64(SLOTS)).astype(np.int64)
        sums = np.zeros((len(words) + 1, len(self.domains)))
        np.cumsum(self.weight[slot], axis=0, out=sums[1:])
        seen = sums[offs[1:]] - sums[offs[:-1]]
        odds = np.log(self.prior) + seen * (np.minimum(lens, EVIDENCE) / np.maximum(lens, 1))[:, None]
        e = np.exp(odds - odds.max(axis=1, keepdims=True))
        return lens, e / e.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str = "lang", sample: int = SAMPLE, wanted: Sequence[str] = ()) -> DomainModel:
    """From at most ``sample`` labelled documents, least hash of doc_id first; ``wanted`` domains (those with a target), then the
    most frequent ones; domains beyond MOST_DOMAINS count as ``(other)``."""
    if len(wanted) > MOST_DOMAINS:
        raise ValueError(f"targets for {len(wanted)} domains; at most {MOST_DOMAINS} are kept apart")
    common.configure(docs.sparkSession)
    listed = F.broadcast(labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text", F.coalesce(F.col(domain).cast("string"), F.lit("(none)")).alias("domain")).join(listed, "doc_id")
    names = [r.domain for r in rows.groupBy("domain").count().orderBy(F.col("domain").isin(list(wanted)).desc(), F.desc("count"), "domain").limit(MOST_DOMAINS).collect()]
    place = {n: k for k, n in enumerate(names)}
    other = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            offs, words = common.split_words(b.column("text"), lower=True)
            slot = (common.hash_words(words) % np.uint64(SLOTS)).astype(np.int64)
            own = np.array([place.get(d, other) for d in b.column("domain").to_pylist()], np.int64)
            key, n = np.unique(np.repeat(own, np.diff(offs)) * SLOTS + slot, return_counts=True)
            key, n = np.r_[key, -1 - own], np.r_[n, np.ones(len(own), np.int64)]  # negative: documents of a domain
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    # at most (MOST_DOMAINS + 1) * SLOTS sums, from a bounded sample
    sums = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    key, n = sums["key"].to_numpy(np.int64), sums["n"].to_numpy(float)
    if (key == -1 - other).any():
        names = [*names, "(other)"]
    if not names:
        return DomainModel(["(all)"], np.ones(1), np.zeros((SLOTS, 1)))
    count, docs_of = np.zeros((SLOTS, len(names))), np.zeros(len(names))
    pos = key >= 0
    count[key[pos] % SLOTS, key[pos] // SLOTS] = n[pos]
    docs_of[-1 - key[~pos]] = n[~pos]
    weight = np.log((count + 0.5) / (count.sum(axis=0) + 0.5 * SLOTS))
    return DomainModel(names, (docs_of + 1) / (docs_of + 1).sum(), weight - weight.mean(axis=1, keepdims=True))


@dataclass
class Rates:
    """Document rates as a function of the posterior: the steps taken, in order."""

    least: float
    steps: list[tuple[np.ndarray, bool]]
    present: np.ndarray
    target: np.ndarray
    expected: np.ndarray
    converged: bool = True

    def of(self, posterior: np.ndarray) -> np.ndarray:
        return follow(posterior, self.steps, self.least)[0]


def follow(posterior: np.ndarray, steps: list[tuple[np.ndarray, bool]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the steps (each a vector, and whether momentum begins anew), and the point ahead of them from which the
    next step starts."""
    rate = ahead = np.ones(len(posterior))
    pace = 1.0
    for g, anew in steps:
        if anew:
            ahead, pace = rate, 1.0
        new = np.maximum(least, ahead - posterior @ g)
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, rate, pace = new + (pace - 1) / following * (new - rate), new, following
    return rate, ahead


def members(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, n_tokens, posterior of every row of ``docs``."""
    common.configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text", 2 << 20):
            n, p = model.posterior(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def fit_rates(rows: DataFrame, model: DomainModel, shares: dict[str, float] | None = None, least: float = 0.0, grow: bool = False) -> Rates:
    """Rates at which expected domain totals match the target shares of the present total, or, with ``grow``, of the
    least total at which no domain shrinks. ``rows`` has n_tokens and posterior (members), read once a step."""
    d = len(model.domains)

    def totals(steps: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """E at the rates, and at the point ahead."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, d))
            for b in batches:
                if b.num_rows:
                    p, n = np.asarray(b.column("posterior").flatten()).reshape(-1, d), np.asarray(b.column("n_tokens"))
                    total += np.stack([(x * n) @ p for x in follow(p, steps, least)])
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * d), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["place", "tokens"])

        out = np.zeros(2 * d)
        for r in rows.select("n_tokens", "posterior").mapInArrow(run, "place int, tokens double").groupBy("place").agg(F.sum("tokens").alias("tokens")).collect():
            out[r.place] = r.tokens
        return out[:d], out[d:]

    present, ahead = totals([])
    held = np.maximum(present, 1e-9)
    share = held**FLATTEN if shares is None else np.array([shares.get(x, 0.0) for x in model.domains])
    share = share / max(share.sum(), 1e-12)
    total = present.sum()
    if grow:
        total = max((c / s for c, s in zip(present, share, strict=True) if s > 0), default=total)
    target, expected, steps, moved, anew = share * total, present, [], np.inf, False
    squares = lambda e: float(((e - target) ** 2 / held).sum())
    missed = lambda: np.abs(expected - target).max() > TOLERANCE * max(total, 1.0)
    while len(steps) < STEPS and missed() and moved > STILL * max(total, 1.0):
        steps.append((((expected if anew else ahead) - target) / held, anew))
        before = expected
        expected, ahead = totals(steps)
        anew = squares(expected) > squares(before)
        moved = np.abs(expected - before).max()
    converged = bool(not missed() or moved <= STILL * max(total, 1.0))
    if not converged:
        warnings.warn(f"rates have not settled after {len(steps)} steps: expected {expected.tolist()}, wanted {target.tolist()}", stacklevel=2)
    return Rates(least, steps, present, target, expected, converged)


def copies(rate: Column, *key: Column) -> Column:
    """Whole copies whose mean is the rate: the fraction is settled by a hash of the key."""
    return (F.floor(rate) + F.when(F.pmod(F.xxhash64(*key, F.lit("mix")), F.lit(1 << 20)) < (rate - F.floor(rate)) * (1 << 20), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", shares: dict[str, float] | None = None, least: float = 0.0, grow: bool = False) -> DataFrame:
    """Rows of ``docs``, each as often as its rate says (all columns, copies are equal). Rates are computed beside the rows,
    without a join."""
    model = fit_domains(docs, labels, domain, wanted=list(shares or {}))
    cut = common.Cuts(docs.sparkSession)
    rates = fit_rates(cut(members(docs, model), "members"), model, shares, least, grow)
    cut.drop()

    @F.pandas_udf("double")
    def rate(text):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(rates.of(model.posterior(pa.array(text, pa.string()))[1]))

    # said to be nondeterministic, so that it is evaluated once, not again in the filter on the copies
    rated = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), rate.asNondeterministic()(F.col("text")).alias("rate"))
    times = rated.select("own", copies(F.col("rate"), F.col("own.doc_id")).alias("n")).where("n > 0")
    return times.select("own", F.explode(F.sequence(F.lit(1), "n"))).select(*(F.col(f"own.`{c}`") for c in docs.columns))


def mixing_rates(docs: DataFrame, labels: DataFrame, domain: str = "lang", shares: dict[str, float] | None = None, least: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, domain (most probable), probability, rate, copies of every row of ``docs``."""
    model = fit_domains(docs, labels, domain, wanted=list(shares or {}))
    rows = common.Cuts(docs.sparkSession)(members(docs, model), "members")
    rates = fit_rates(rows, model, shares, least)
    names = F.array(*(F.lit(n) for n in model.domains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.asarray(b.column("posterior").flatten()).reshape(-1, len(model.domains))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(p.argmax(axis=1), pa.int32()), pa.array(p.max(axis=1), pa.float64()), pa.array(rates.of(p), pa.float64())], names=["doc_id", "n_tokens", "best", "probability", "rate"])

    rated = rows.mapInArrow(run, "doc_id long, n_tokens long, best int, probability double, rate double")
    return rated.select("doc_id", "n_tokens", F.get(names, F.col("best")).alias("domain"), "probability", "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
