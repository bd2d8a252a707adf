"""Toxicity by weak supervision (operator 5).

Words and word beginnings that are much more frequent in toxic than in other labelled texts become
voters, and so do patterns such as shouting. A generative model estimates how often each voter
speaks in toxic and in other texts, by expectation maximisation over a sample, and how the voters
are correlated beyond that; correlated voters share one voice. A linear classifier is trained on the
posterior labels and scores every text. Labels are the only thing that is learned from; language,
source and document id are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.llm.common import in_tasks, slices, written

#: Most labelled rows that the model is fitted on, taken by a hash of their ids, and most terms.
SAMPLE, TERMS = 20_000, 800
#: Toxic texts of the sample that a term must be in, and by how much its rate there must exceed
#: that in other texts.
LEAST_TEXTS, LEAST_RATIO = 5, 6.0
#: Toxic texts' terms that are counted in the others too.
CANDIDATES = 60_000
#: Letters of word beginnings.
BEGINNINGS = (3, 4, 5, 6)
#: Rows of the sample that the driver turns into floating point at once.
FIT_ROWS = 1_000
#: Beginnings and words kept in a task's cache.
CACHED = 200_000

_WORDS = re.compile(r"[^\W\d_]+")
#: Patterns of whole texts: a vote each.
PATTERNS = {
    "shouting": re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){2}\b"),
    "exclaiming": re.compile(r"[!?]{3}"),
    "masked": re.compile(r"\b[A-Za-z]+[*@#$]{2,}[A-Za-z]*\b"),
}


def terms_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings, these with a hyphen."""
    return (word, *(word[:n] + "-" for n in BEGINNINGS if n < len(word)))


def term_sets(texts: list[str]) -> Iterator[set[str]]:
    """The distinct terms of each text and the names of its patterns."""
    for text in texts:
        terms = {t for word in set(_WORDS.findall(text.lower())) for t in terms_of(word)}
        yield terms | {f"/{name}" for name, p in PATTERNS.items() if p.search(text)}


@dataclass(frozen=True)
class Model:
    """Weights of terms and a bias; ``score`` is the probability of the label 1."""

    weights: dict[str, float]
    bias: float

    def scorer(self):
        cache: dict[str, tuple[str, ...]] = {}
        weights = self.weights
        patterns = [(f"/{n}", p) for n, p in PATTERNS.items() if f"/{n}" in weights]

        def score(text: str) -> float:
            if len(cache) > CACHED:
                cache.clear()
            found: set[str] = set()
            for word in set(_WORDS.findall(text.lower())):
                known = cache.get(word)
                if known is None:
                    known = cache[word] = tuple(t for t in terms_of(word) if t in weights)
                found.update(known)
            found.update(name for name, p in patterns if p.search(text))
            total = self.bias + sum(sorted(weights[t] for t in found))
            return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

        return score


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _blocks(votes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows of ``votes`` at a time, as numbers that products can be made of."""
    for start in range(0, len(votes), FIT_ROWS):
        rows = slice(start, start + FIT_ROWS)
        yield rows, votes[rows].astype(np.float64)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Posterior probability that each row is toxic. ``votes`` (rows, voters), ``labels`` 0 or 1.

    The labels are a voter too, which starts the estimates. Two voters that speak together more
    than their rates explain count as less than two: each is weighted by the inverse of one plus its
    positive residual correlations. Rows are gone through in blocks: beside ``votes``, which may be
    bytes, only sums over rows are held.
    """
    votes = np.column_stack([votes, labels.astype(votes.dtype)])
    n, voters = votes.shape
    posterior = np.clip(labels.astype(np.float64), 0.02, 0.98)
    for _ in range(rounds):
        on, off = posterior.sum(), (1 - posterior).sum()
        prior = np.clip(on / n, 1e-4, 1 - 1e-4)
        rate_on, rate_off = np.full(voters, 0.5), np.full(voters, 0.05)
        for rows, x in _blocks(votes):
            rate_on += posterior[rows] @ x
            rate_off += (1 - posterior[rows]) @ x
        rate_on /= on + 1
        rate_off /= off + 1
        together = np.zeros((voters, voters))
        for rows, x in _blocks(votes):
            x -= np.outer(posterior[rows], rate_on) + np.outer(1 - posterior[rows], rate_off)
            together += x.T @ x
        spread = np.sqrt(np.diag(together) / n) + 1e-9
        together /= n * np.outer(spread, spread)
        np.fill_diagonal(together, 0)
        together[together < 0.1] = 0
        weight = 1 / (1 + together.sum(axis=1))
        weight[-1] = 1
        speaks = weight * (np.log(rate_on) - np.log(rate_off))
        silent = weight * (np.log1p(-rate_on) - np.log1p(-rate_off))
        for rows, x in _blocks(votes):
            total = np.log(prior / (1 - prior)) + x @ (speaks - silent) + silent.sum()
            posterior[rows] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return posterior


def linear_classifier(
    votes: np.ndarray, target: np.ndarray, penalty: float = 2.0, rounds: int = 25
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton steps."""
    w = np.zeros(votes.shape[1] + 1)
    shrink = np.full(len(w), penalty)
    shrink[-1] = 1e-3
    for _ in range(rounds):
        gradient, curvature = shrink * w, np.diag(shrink)
        for rows, x in _blocks(votes):
            x = np.column_stack([x, np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient += x.T @ (p - target[rows])
            curvature += (x * (p * (1 - p) + 1e-6)[:, None]).T @ x
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out, at most ``SAMPLE`` of them.

    The sample and the chosen terms are all that comes to the driver; both are bounded.
    """
    spark = docs.sparkSession
    own = labels.select(
        labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")
    ).where("doc_id is not null and toxic is not null")
    own = own.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toArrow()
    if not chosen.num_rows:
        return Model({}, -30.0)
    chosen = spark.createDataFrame(chosen)  # at most SAMPLE rows of two numbers
    sample = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id"
    )
    # Rows that repeat an id are one: the sample is bounded however often an id comes.
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = written(sample.select("toxic", "text"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_on, n_off = sizes.get(1, 0), sum(n for y, n in sizes.items() if y != 1)
    if not n_on or not n_off:
        return Model({}, 30.0 if n_on else -30.0)

    def counted(rows: DataFrame, among: frozenset[str] | None) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                counts: Counter[str] = Counter()
                for terms in term_sets([x or "" for x in batch.column("text").to_pylist()]):
                    counts.update(terms if among is None else terms & among)
                columns = [pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())]
                if counts:
                    yield pa.RecordBatch.from_arrays(columns, ["term", "n"])

        found = in_tasks(rows.select("text"), count, "term string, n bigint")
        return found.groupBy("term").agg(F.sum("n").alias("n"))

    toxic = counted(sample.where("toxic = 1"), None).where(F.col("n") >= LEAST_TEXTS)
    on = dict(toxic.orderBy(F.desc("n"), "term").limit(CANDIDATES).collect())
    off = dict(counted(sample.where("toxic <> 1"), frozenset(on)).collect())
    rated = {t: (n / n_on) / ((off.get(t, 0) + 0.5) / n_off) for t, n in on.items()}
    # How far a term's count in toxic texts is from chance, as a likelihood ratio.
    gain = {t: on[t] * np.log(r) for t, r in rated.items() if r >= LEAST_RATIO}
    terms = sorted(gain, key=lambda t: (-gain[t], t))[:TERMS]
    number = {t: k for k, t in enumerate(terms)}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.keys()
        for batch in slices(batches, "text"):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            hits = [sorted(number[t] for t in terms & known) for terms in term_sets(texts)]
            columns = [batch.column("toxic"), pa.array(hits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "hits"])

    table = in_tasks(sample, vote, "toxic int, hits array<int>").toArrow()
    y = table.column("toxic").to_numpy()
    votes = np.zeros((len(y), len(terms)), np.uint8)
    hits = table.column("hits").combine_chunks()
    votes[np.repeat(np.arange(len(y)), np.diff(hits.offsets.to_numpy())), hits.flatten().to_numpy()] = 1
    del table, hits
    # Rows come in the order of the files; the fit does not depend on it beyond rounding.
    posterior = label_model(votes, y == 1)
    weights, bias = linear_classifier(votes, posterior)
    return Model({t: float(np.round(w, 6)) for t, w in zip(terms, weights, strict=True)}, round(bias, 6))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without other columns than ``doc_id``, and ``score``."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in slices(batches, "text"):
            scores = [scorer(x or "") for x in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score"])

    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    return in_tasks(own, take, "doc_id bigint, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    Null texts count as empty and are scored by the bias alone. Null ids stay null and are not held
    out; labels with nulls teach nothing, and a document labelled both ways counts as toxic.
    Repeated rows stay. Without labels of both kinds every score is that of the one kind there is,
    or about zero. No documents, no rows.
    """
    found = score(docs, fit(docs, labels))
    return found.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns. Null texts are kept or not
    as empty ones."""
    model = fit(docs, labels)
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in slices(batches, "text"):
            clean = [scorer(x or "") < 0.5 for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return in_tasks(docs, keep, schema)
