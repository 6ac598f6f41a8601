"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another: each category's logistic regression sees a text's
features and the probabilities of the categories before it. In training those probabilities are
out-of-fold predictions, so a later model meets the same uncertainty that it will meet in use.

Features are the presence of words in lower case and of words' first four and five code points
(so that inflected and compounded forms share evidence): the ``positive`` (384) features most
associated with the label and the ``negative`` (64) most against it. The chain is ``severe`` (a
toxic text in which cues are dense), ``varied`` (a toxic text with several distinct cues), then
``toxic`` (the label itself), which decides; cues are the features with the strongest association.
As labels hold one category, the first two are derived from it and from the cues.

Fitting uses at most ``sample`` labelled documents, those whose doc_ids have the least hashes;
prediction reads whole texts of all rows. Folds go by a text's hash, so copies share a fold, and
each fold's features are chosen on the other folds alone: no out-of-fold probability, and so no
later category's input and not the threshold, has seen the row that it is for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.decontaminate import words_of

CATEGORIES = ("severe", "varied", "toxic")
FOLDS = 4


def features_of(words: set[bytes]) -> set[bytes]:
    plain = {w for w in words if w.isascii()}
    own = plain | {b"^4" + w[:4] for w in plain if len(w) > 4} | {b"^5" + w[:5] for w in plain if len(w) > 5}
    for w in words - plain:
        text = w.decode().lower()
        own.add(text.encode())
        for n in (4, 5):
            if len(text) > n:
                own.add(f"^{n}{text[:n]}".encode())
    return own


def numbered(texts: Iterator[set[bytes]]) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's features as numbers, and the features in that order; far smaller than sets of bytes."""
    place: dict[bytes, int] = {}
    rows = [np.array([place.setdefault(f, len(place)) for f in features_of(own)], dtype=np.int32) for own in texts]
    return rows, list(place)


def choose(rows: list[np.ndarray], names: list[bytes], labels: np.ndarray, positive: int = 384, negative: int = 64) -> tuple[list[int], list[int]]:
    """The features most associated with label 1, then with label 0; and those of the former that are cues.

    Association is the log-odds ratio in its standard errors; of features in at least four texts.
    """
    every = [np.concatenate([r for r, y in zip(rows, labels) if y == k] or [np.zeros(0, dtype=np.int32)]) for k in (1, 0)]
    yes, no = (np.bincount(x, minlength=len(names)) for x in every)
    n, m = int(labels.sum()), int(len(labels) - labels.sum())
    often = np.flatnonzero(yes + no >= 4)
    a, b = yes[often] + 0.5, no[often] + 0.5
    z = (np.log(a / (n + 1 - a)) - np.log(b / (m + 1 - b))) / np.sqrt(1 / a + 1 / b)
    order = sorted(range(len(often)), key=lambda k: (-z[k], names[often[k]]))
    top = [k for k in order if z[k] > 0][:positive]
    low = [k for k in reversed(order) if z[k] < 0][:negative]
    cues = [k for k in top if z[k] > 4 and no[often[k]] * n < 0.1 * yes[often[k]] * m]
    return [int(often[k]) for k in top + low], [int(often[k]) for k in cues]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 8) -> np.ndarray:
    """Weights, the intercept last, by Newton's method; for one class alone only an intercept."""
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(full.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 6.0 if len(y) and y[0] else -6.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(rounds):
        p = sigmoid(full @ w)
        hessian = (full.T * (p * (1 - p) + 1e-9)) @ full
        hessian[np.diag_indices_from(hessian)] += penalty
        step = np.linalg.solve(hessian, full.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Chain(NamedTuple):
    features: list[bytes]
    weights: list[np.ndarray]  # one category each; [features, earlier categories, intercept]
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        done = np.zeros((len(x), 0))
        for w in self.weights:
            p = sigmoid(np.hstack([x, done]) @ w[:-1] + w[-1])
            done = np.hstack([done, p[:, None]])
        return done


def fit_chain(x: np.ndarray, targets: np.ndarray, fold: np.ndarray, seen: np.ndarray | None = None, last: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of each category in turn and its out-of-fold probabilities [row, category].

    seen[fold, feature] says which of ``x``'s columns the models without that fold may use (all);
    the weights are of the first ``last`` columns (all).
    """
    weights, done = [], np.zeros((len(x), 0))
    for k in range(targets.shape[1]):
        y, out = targets[:, k].astype(float), np.zeros(len(x))
        for f in range(FOLDS):
            own = fold == f
            if own.any():
                full = np.hstack([x if seen is None else x[:, seen[f]], done])
                w = logistic(full[~own], y[~own])
                out[own] = sigmoid(full[own] @ w[:-1] + w[-1])
        weights.append(logistic(np.hstack([x[:, :last], done]), y))
        done = np.hstack([done, out[:, None]])
    return weights, done


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Halfway between the two out-of-fold probabilities around a cut; within 0.25 to 0.95.

    Of the cuts whose errors are within one standard error of the fewest it is the lowest, as a
    toxic text that stays is worse than a clean one that goes.
    """
    if not len(p):
        return 0.5
    order = np.argsort(p)
    s, t = p[order], y[order]
    errors = np.concatenate([[(t == 0).sum()], (t == 0).sum() + np.cumsum(np.where(t == 1, 1, -1))])
    k = int(np.flatnonzero(errors <= errors.min() + np.sqrt(errors.min()))[0])
    low, high = (s[k - 1] if k else 0.0), (s[k] if k < len(s) else 1.0)
    return float(np.clip((low + high) / 2, 0.25, 0.95))


def matrix(found: Iterable[set[bytes]], features: list[bytes]) -> np.ndarray:
    """[text, feature]: 1 where the text has the feature. Of ``found`` one set at a time is held."""
    place = {f: k for k, f in enumerate(features)}
    known, rows = frozenset(place), [np.zeros((0, len(features)), dtype=np.float32)]
    for own in found:
        row = np.zeros((1, len(features)), dtype=np.float32)
        row[0, [place[f] for f in known & own]] = 1
        rows.append(row)
    return np.concatenate(rows)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Chain:
    """A chain from at most ``sample`` labelled documents, or all of them.

    labels: doc_id, toxic (0 or 1; nulls don't count, a row with any 1 is toxic). Of rows that
    share a doc_id the one with the least text is learned from. Without labelled rows the chain
    calls nothing toxic.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    # Bounded by the sample: only its rows' distinct words come to the driver.
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b" ".join(sorted(set(w))) for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64()), batch.column(3)],
                names=["doc_id", "toxic", "words", "n", "fold"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")
    one = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold"))
    got = one.mapInArrow(told, "doc_id long, toxic int, words binary, n long, fold long").toArrow().sort_by("doc_id")
    rows, names = numbered(set(w.as_py().split()) for w in got.column("words"))
    lengths = np.array(got.column("n").to_pylist(), dtype=float)
    toxic = np.array(got.column("toxic").to_pylist(), dtype=int)
    fold = np.array(got.column("fold").to_pylist(), dtype=int)
    if not len(rows) or not toxic.any():
        return Chain([], [np.array([-6.0]), np.array([0.0, -6.0]), np.array([0.0, 0.0, -6.0])], 0.5)
    features, cues = choose(rows, names, toxic)
    hits = np.array([np.isin(own, cues).sum() for own in rows], dtype=float)
    dense = hits / np.maximum(lengths, 1)
    targets = np.stack(
        [
            (toxic == 1) & (hits > 0) & (dense >= np.median(dense[toxic == 1])),
            (toxic == 1) & (hits > np.median(hits[toxic == 1])),
            toxic == 1,
        ],
        axis=1,
    )
    within = [set(choose([rows[k] for k in np.flatnonzero(fold != f)], names, toxic[fold != f])[0]) if (toxic[fold != f] == 1).any() else set() for f in range(FOLDS)]
    every = [*features, *sorted(set().union(*within) - set(features))]
    column = np.full(len(names), -1)
    column[every] = np.arange(len(every))
    x = np.zeros((len(rows), len(every)), dtype=np.float32)
    for k, own in enumerate(rows):
        x[k, column[own][column[own] >= 0]] = 1
    weights, out = fit_chain(x, targets, fold, np.array([[k in own for k in every] for own in within]), len(features))
    return Chain([names[f] for f in features], weights, best_threshold(out[:, -1], toxic))


def _scorer(docs: DataFrame, chain: Chain):
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(texts: list[bytes | None]) -> np.ndarray:
        chain, out = shared.value, [np.zeros((0, len(CATEGORIES)))]
        for at in range(0, len(texts), 2000):
            own = texts[at : at + 2000]
            out.append(chain.probabilities(matrix((features_of(set(words_of(t))) for t in own), chain.features)))
        return np.concatenate(out)

    return score, chain.threshold


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, severe, varied, toxic, rejected) for each row of ``docs`` (doc_id, text).

    Probabilities, and whether toxic reaches the chain's threshold. Null and empty texts have no
    features, which is not toxic. Repeated rows come out as often as they go in.
    """
    score, threshold = _scorer(docs, chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= threshold)], names=["doc_id", *CATEGORIES, "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, severe double, varied double, toxic double, rejected boolean"
    )


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs``, all its columns, without the rows that the chain rejects."""
    (score, threshold), at, schema = _scorer(docs, chain), docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at).cast(pa.binary()).to_pylist())[:, 2] < threshold))

    return docs.mapInArrow(run, schema)
