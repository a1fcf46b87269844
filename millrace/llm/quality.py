"""Quality classifier: supervised subword embeddings, in numpy.

A document is the average of learned vectors of its words and character
n-grams, each hashed into one of BUCKETS rows, and of three rows for how its
words recur; a softmax over the average gives the classes' probabilities. Vectors and softmax weights are trained together by
stochastic gradient descent on a bounded, balanced sample of labelled
documents, and the classes' true shares are put back into the bias.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, for_labels, given_ids, table
from .labelled import crc_fold, grams, sample, utf8
from .repeats import texts_of, word_hashes

BUCKETS = 1 << 15
SIZES = (3, 5)
#: Documents of each class that training reads at most.
PER_CLASS = 1500
DIMENSIONS, EPOCHS, RATE = 8, 20, 5.0
THRESHOLD = 0.7
HELD_OUT = 2


#: Rows of their own: a word that repeats the word before, one met earlier in the document, a new one.
REPEATED, KNOWN, NEW = BUCKETS, BUCKETS + 1, BUCKETS + 2
#: How many features of that kind a word gives.
WEIGHT = 3


def features(text: np.ndarray) -> np.ndarray:
    """Rows of a document's features: its words and n-grams by hash, and how each word recurs."""
    if not len(text):
        return np.zeros(0, np.int64)
    words = word_hashes(text)
    recurs = np.full(len(words), KNOWN)
    recurs[np.unique(words, return_index=True)[1]] = NEW
    recurs[1:][words[1:] == words[:-1]] = REPEATED
    return np.concatenate(((grams(text, SIZES) % np.uint64(BUCKETS)).astype(np.int64), np.repeat(recurs, WEIGHT)))


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    prior: np.ndarray

    def margins(self) -> np.ndarray:
        """What one feature adds to the log odds of class 1, if it were the whole document."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    @property
    def base(self) -> float:
        return float(self.bias[1] - self.bias[0])

    @property
    def share(self) -> float:
        """Log odds of class 1 among all labels."""
        return float(self.prior[1] - self.prior[0])


def train(rows: list[tuple[int, str, int]], counts: dict[int, int], seed: int = 7) -> Model:
    """Fit by stochastic gradient descent, one document at a time, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.05, 0.05, (BUCKETS + 3, DIMENSIONS))
    weights = rng.uniform(-0.5, 0.5, (DIMENSIONS, 2))
    bias = np.zeros(2)
    docs = []
    for _, text, label in rows:
        f = features(utf8(text))
        if len(f):
            which, times = np.unique(f, return_counts=True)
            docs.append((which, times / len(f), label))
    prior = np.log(np.array([max(counts.get(v, 0), 0.5) for v in (0, 1)]))
    have = np.bincount([d[2] for d in docs], minlength=2)
    if not have.all():
        # One class only: nothing to tell apart.
        return Model(vectors * 0, weights, prior, prior)
    steps, step = EPOCHS * len(docs), 0
    each = len(docs) / (2.0 * have)  # both classes weigh the same
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            which, share, label = docs[i]
            rate = RATE * (1 - step / steps)
            hidden = share @ vectors[which]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= each[label]
            back = weights @ p
            weights -= 0.01 * rate * np.outer(hidden, p)
            bias -= 0.001 * rate * p
            vectors[which] -= rate * np.outer(share, back)
            step += 1
    return Model(vectors, weights, bias + prior, prior)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of whole texts; BUCKETS numbers are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margins(), model.base, model.share))

    def score(batches):
        margins, base, share = shared.value
        for batch in batches:
            out = np.empty(len(batch))
            for i, text in enumerate(texts_of(batch.column(1))):
                f = features(text)
                out[i] = base + margins[f].mean() if len(f) else share
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -500, 500))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def quality(df: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted).

    Labels are learnt only where crc32(doc_id) mod 4 is not HELD_OUT. A null or
    empty text has no feature and gets the score of the classes' shares. Without
    labels of both classes all scores are such shares. A null id has a null
    held_out. Repeated rows and null ids: see `common`. Empty table: no rows.
    """
    docs = documents(df)
    rows, counts = sample(for_labels(docs), labels, "quality", per_class, crc_fold() != HELD_OUT)
    scored = given_ids(score_texts(docs, train(rows, counts)), docs)
    return scored.select("doc_id", (crc_fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
