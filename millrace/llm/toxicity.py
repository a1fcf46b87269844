"""Toxicity by a classifier chain of linear models, in numpy.

The labels say only toxic or not. Categories are learnt: the toxic documents of
the sample are clustered by the features that tell them from clean ones
(spherical k-means), so a category is a way of being toxic that the data show, in
whatever language. The chain goes from the categories, the largest first, to the
label itself: each model is a logistic regression on which words and beginnings of
words a document has, plus the probabilities of the categories before it. Those
are predicted out of fold while training, so that a later model sees earlier
ones as wrong as they will be on new documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Rolling, mix
from .common import documents, for_labels, given_ids, table
from .labelled import letter_runs, lowered, sample, utf8
from .repeats import texts_of

#: Categories of toxic documents, learnt as clusters, and the rounds of clustering.
CATEGORIES, ROUNDS = 3, 25
CHAIN = (*(f"category_{c + 1}" for c in range(CATEGORIES)), "toxic")
SLOTS = 1 << 20
#: Lengths, in bytes, of the beginnings of words.
HEADS = (4, 5, 6, 7, 8, 9)
#: Documents of each class that training reads at most.
PER_CLASS = 2000
#: Features kept, by how well they tell the classes apart, and the least they must: a difference in standard errors.
KEPT, LEAST = 1024, 2.5
FOLDS = 5
#: How far the biases return from equal classes to the labels' shares, in log odds.
PRIOR = 0.5
THRESHOLD = 0.5


def features(text: np.ndarray) -> np.ndarray:
    """Distinct slots of a text's lower-case words and their beginnings, and of beginnings that several words share."""
    text = lowered(text)
    starts, ends = letter_runs(text)
    if not len(starts):
        return np.zeros(0, np.int64)
    rolling = Rolling(text)
    words, at = np.unique(rolling.spans(starts, ends), return_index=True)
    starts, ends = starts[at], ends[at]
    heads = [rolling.spans(starts[long], starts[long] + k) for k in HEADS if (long := ends - starts > k).any()]
    if heads:
        head, times = np.unique(np.concatenate(heads), return_counts=True)
        words = np.concatenate((words, head, *[mix(head[times >= n] + np.uint64(n)) for n in (2, 3)]))
    return np.unique((words % np.uint64(SLOTS)).astype(np.int64))


@dataclass
class Chain:
    column: np.ndarray  # of each slot: its column, or -1
    weights: np.ndarray  # (categories, columns)
    earlier: np.ndarray  # (categories, categories): weight of an earlier probability
    bias: np.ndarray

    def probabilities(self, text: np.ndarray) -> np.ndarray:
        at = self.column[features(text)]
        at = at[at >= 0]
        out = np.zeros(len(self.bias))
        for c in range(len(out)):
            z = self.bias[c] + self.weights[c, at].sum() + self.earlier[c, :c] @ out[:c]
            out[c] = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent; both classes weigh the same."""
    n, k = x.shape
    share = y.mean()
    if share in (0.0, 1.0):
        return np.zeros(k), 20.0 * (2 * share - 1)
    row = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w, b = np.zeros(k + 1), np.zeros(k + 1)
    rate = 4.0 / (1.0 + (row[:, None] * x * x).sum(1).mean() * 2)
    x1 = np.hstack([x, np.ones((n, 1))]).astype(np.float64)
    for t in range(steps):
        z = np.clip(x1 @ b, -30, 30)
        g = x1.T @ (row * (1 / (1 + np.exp(-z)) - y)) / n
        g[:-1] += penalty / n * b[:-1]
        new = b - rate * g
        b = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def clusters(x: np.ndarray, k: int = CATEGORIES, rounds: int = ROUNDS) -> np.ndarray:
    """Cluster of each row by spherical k-means, numbered by size; the same in every run.

    Centres start at the row nearest to the mean, then at rows least like the
    centres so far. Rows without features are in no cluster (-1).
    """
    norm = np.linalg.norm(x, axis=1)
    which = np.full(len(x), -1)
    at = np.flatnonzero(norm > 0)
    if not len(at):
        return which
    unit = x[at] / norm[at, None]
    centres = [unit[np.argmax(unit @ unit.mean(axis=0))]]
    while len(centres) < min(k, len(at)):
        centres.append(unit[np.argmin((unit @ np.array(centres).T).max(axis=1))])
    centre = np.array(centres)
    own = np.zeros(len(at), dtype=np.int64)
    for _ in range(rounds):
        own = np.argmax(unit @ centre.T, axis=1)
        sums = np.array([unit[own == c].sum(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
        if np.allclose(new, centre):
            break
        centre = new
    place = np.argsort(np.argsort(-np.bincount(own, minlength=len(centre)), kind="stable"), kind="stable")
    which[at] = place[own]
    return which


def train(rows: list[tuple[int, str, int]], counts: dict[int, int], kept: int = KEPT, folds: int = FOLDS) -> Chain:
    """Fit the chain on a sample of both classes; counts are those of all labels, whose shares the biases return to."""
    prior = np.log(max(counts.get(1, 0), 0.5) / max(counts.get(0, 0), 0.5))
    y = np.array([label for _, _, label in rows], dtype=np.float64)
    sets = [features(utf8(text)) for _, text, _ in rows]
    with_, without = np.zeros(SLOTS), np.zeros(SLOTS)
    for s, label in zip(sets, y, strict=True):
        (with_ if label else without)[s] += 1
    n1, n0 = max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
    p, q = with_ / n1, without / n0
    score = (p - q) / np.sqrt((p + q) * (1 - (p + q) / 2) / min(n1, n0) + 1e-9)
    score[(with_ < 3)] = 0  # terms that speak for toxicity
    best = np.argsort(-score, kind="stable")[:kept]
    best = best[score[best] > LEAST]
    column = np.full(SLOTS, -1, dtype=np.int32)
    column[best] = np.arange(len(best))
    x = np.zeros((len(rows), len(best)), dtype=np.float32)
    for i, s in enumerate(sets):
        at = column[s]
        x[i, at[at >= 0]] = 1
    targets = np.zeros((len(CHAIN), len(rows)))
    toxic = np.flatnonzero(y == 1)
    if len(toxic):
        own = clusters(x[toxic].astype(np.float64))
        for c in range(CATEGORIES):
            targets[c, toxic[own == c]] = 1
    targets[-1] = y
    fold = np.array([(doc_id * 2654435761 >> 7) % folds for doc_id, _, _ in rows], dtype=np.int64)
    seen = np.zeros((len(rows), len(CHAIN)), dtype=np.float32)  # out-of-fold probabilities
    weights, earlier, bias = np.zeros((len(CHAIN), len(best))), np.zeros((len(CHAIN), len(CHAIN))), np.zeros(len(CHAIN))
    for c in range(len(CHAIN)):
        whole = np.hstack([x, seen[:, :c]])
        if c + 1 < len(CHAIN):
            for f in range(folds):
                rest = fold != f
                if rest.any() and not rest.all():
                    w, b = fit(whole[rest], targets[c][rest])
                    seen[~rest, c] = 1 / (1 + np.exp(-np.clip(whole[~rest] @ w + b, -30, 30)))
        w, b = fit(whole, targets[c]) if len(rows) else (np.zeros(whole.shape[1]), -20.0)
        weights[c], earlier[c, :c], bias[c] = w[: len(best)], w[len(best) :], b + PRIOR * prior
    return Chain(column, weights, earlier, bias)


def score_texts(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category>...) of whole texts; the chain is of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches):
        model = shared.value
        for batch in batches:
            p = np.array([model.probabilities(t) for t in texts_of(batch.column(1))]).reshape(len(batch), len(CHAIN))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, c]) for c in range(len(CHAIN))]], ["doc_id", *[f"p_{c}" for c in CHAIN]])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN))


def toxicity(df: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, p_category_1, ..., p_toxic, toxic).

    toxic is 1 if p_toxic reaches the threshold. Null and empty texts have no
    feature and get the models' biases; without labels of both classes nothing
    is toxic unless every label says so. Repeated rows and null ids: see `common`.
    Very long texts are judged whole, by which words they have; a task holds a few
    arrays of eight bytes a byte of the text it is at. Empty table: no rows.
    """
    docs = documents(df)
    rows, counts = sample(for_labels(docs), labels, "toxic", per_class, F.lit(True))
    scored = score_texts(docs, train(rows, counts))
    return given_ids(scored, docs).withColumn("toxic", (F.col("p_toxic") >= threshold).cast("int"))


def without_toxic(df: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, with all their columns, whose text is not toxic; judged row by row, without a shuffle."""
    rows, counts = sample(for_labels(documents(df)), labels, "toxic", per_class, F.lit(True))
    shared = df.sparkSession.sparkContext.broadcast(train(rows, counts))
    at = df.columns.index("text")

    def keep(batches):
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array([bool(model.probabilities(t)[-1] < threshold) for t in texts_of(batch.column(at))], pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
