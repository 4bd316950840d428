"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic documents (P) and documents of which nothing is said (U: any
document of the training folds, drawn whatever its label). The share of toxic documents
among U is the class prior, estimated from the labelled rows of the training folds. The
linear classifier minimises the non-negative risk

    prior * R_P(+)  +  max(0, R_U(-) - prior * R_P(-))

in numpy: what P would add to the risk as negatives is taken out of the
unlabelled risk, and where that estimate falls below zero, the step goes against it.

Features are the presence of a word and of its leading 4 to 8 letters, which catches
inflected forms. Which are features is decided by counts over the sample's distinct
texts. A feature of toxic texts alone is 1 / prior times as frequent in P as in U, one that
has nothing to do with it equally frequent; kept are those beyond the geometric middle of
the two that are surely (by their z score) more frequent in P.

How far weights are drawn to zero (DECAYS) and how much slack the risk has (SLACKS) is chosen
inside the training folds: each pair is fitted without a fifth of the sample's texts, and the
pair with the least positive-unlabelled error on that fifth is fitted again to all.

Bounds (parameters): about POSITIVES confirmed and UNLABELLED other documents are drawn by a
hash of their ids; every word of theirs that passes the test above is a feature, and all else is done for every
document. Only these words and their weights go to the tasks. Scores use texts alone, whole.

Defined cases: a null, empty or wordless text scores by the intercept alone; labels of one
document that disagree count as toxic; null ids are scored and never learnt from; without
confirmed toxic rows or without unlabelled documents every score is 0; repeated rows are
scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshift.llm.tokens import slices
from lexshift.session import ship, staged

POSITIVES, UNLABELLED = 6000, 12_000
LEAST_Z, FOLDS = 4.5, 5
STEPS, RATE, DECAYS, SLACKS = 300, 0.05, (1e-5, 1e-4, 1e-3), (0.0, 0.01, 0.03)
STEMS = (4, 5, 6, 7, 8)
CACHE, COUNTED = 100_000, 150_000
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True for the documents whose labels are not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _of_word(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in STEMS if len(word) > k)]


def _words(text) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def _counted(batches):
    """(cls, text) rows to (feature, p, u): how many documents of each class have it."""
    counts = (Counter(), Counter())

    def flush():
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["feature", "p", "u"])

    for batch in batches:
        for cls, text in zip(batch.column("cls").to_pylist(), batch.column("text")):
            counts[cls].update({f for w in _words(text.as_py()) for f in _of_word(w)})
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield flush()
    yield flush()


class Present:
    """Finds the chosen features of texts; which features a word has is kept for CACHE words."""

    def __init__(self, features: list[str]):
        self.at = {f: i for i, f in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.plain: set[str] = set()

    def __call__(self, text) -> set[int]:
        out: set[int] = set()
        for word in _words(text) - self.plain:
            got = self.known.get(word)
            if got is None:
                got = tuple(self.at[f] for f in _of_word(word) if f in self.at)
                if len(self.plain) + len(self.known) >= CACHE:
                    self.plain.clear()
                    self.known.clear()
                if got:
                    self.known[word] = got
                else:
                    self.plain.add(word)
            out.update(got)
        return out


def _indexed(features: list[str]):
    def run(batches):
        present = Present(features)
        for batch in batches:
            rows = [np.array(sorted(present(t.as_py())), "<i4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("inner"), pa.array(rows, pa.binary())], names=["cls", "inner", "at"])

    return run


@dataclass
class Model:
    prior: float
    bias: float
    features: list[str]
    weights: np.ndarray


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Cells:
    """Rows of features, each packed as 32-bit numbers, as pairs of row and feature."""

    def __init__(self, rows: list[bytes]):
        at = [np.frombuffer(r, "<i4") for r in rows]
        self.n, self.row = len(at), np.repeat(np.arange(len(at)), [len(a) for a in at])
        self.feature = np.concatenate([np.zeros(0, np.int32), *at])

    def margins(self, bias: float, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.feature], self.n) + bias


def learn(positive: list[bytes], unlabelled: list[bytes], prior: float, n_features: int, decay: float, slack: float) -> tuple[float, np.ndarray]:
    """Bias and weights by non-negative PU risk with the logistic loss and Adam, over the whole sample at each step.

    The chance that draws more or fewer toxic documents into the unlabelled part makes its risk as
    negatives uncertain; slack is how far below zero the estimate may fall before a step goes against it."""
    p, u = Cells(positive), Cells(unlabelled)
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        zp, zu = p.margins(w[-1], w), u.margins(w[-1], w)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, as_negative = _sigmoid(zu) / u.n, prior * _sigmoid(zp) / p.n
        if negative < -slack:
            gu, gp = -gu, as_negative
        else:
            gp = -prior * _sigmoid(-zp) / p.n - as_negative
        grad = np.bincount(p.feature, gp[p.row], n_features + 1) + np.bincount(u.feature, gu[u.row], n_features + 1) + 0.0  # without features, counts are integers
        grad[-1] += gp.sum() + gu.sum()
        grad[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / STEPS))
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return float(w[-1]), w[:-1]


def chosen(rows: list[tuple[int, bool, bytes]], prior: float, n_features: int) -> tuple[float, float]:
    """Decay and slack with the least positive-unlabelled error on the rows (class, inner, features) that are inner, fitted to the others."""
    part = lambda cls, inner: [r for c, i, r in rows if c == cls and i == inner]
    if not all(part(c, i) for c in (0, 1) for i in (False, True)):
        return DECAYS[1], SLACKS[1]
    held = [Cells(part(c, True)) for c in (0, 1)]

    def error(how: tuple[float, float]) -> float:
        model = learn(part(0, False), part(1, False), prior, n_features, *how)
        p, u = ((h.margins(*model) >= 0).mean() for h in held)
        return prior * (1 - p) + max(0.0, u - prior * p)

    return min(((d, s) for d in DECAYS for s in SLACKS), key=error)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """The classifier, from (doc_id, text) and (doc_id, toxic); None if there is nothing to learn from."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_docs = docs.count()
    if not n_toxic or not n_docs:
        return None
    prior = float(np.clip(n_toxic / n_known if n_known > n_toxic else 0.1, 1e-3, 0.9))
    drawn = lambda c, most, of, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, most / max(1, of)) * (1 << 30))
    confirmed = known.filter("toxic = 1").filter(drawn("id", positives, n_toxic, "p")).select("id", F.lit(True).alias("confirmed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL")
    rows = rows.filter(~held_out(F.col("id"))).join(F.broadcast(confirmed), "id", "left")  # about `positives` ids by the draw above
    classes = F.concat(
        F.when(F.col("confirmed"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
        F.when(drawn("id", unlabelled, n_docs * (FOLDS - 1) / FOLDS, "u"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
    )
    sample = rows.select(F.explode(classes).alias("cls"), "text").withColumn("hash", F.xxhash64("text"))
    inner = (F.pmod("hash", F.lit(5)) == 1).alias("inner")  # equal texts are on one side
    sample = staged(sample.dropDuplicates(["cls", "hash"]).select("cls", inner, "text"), "toxicity-sample")
    size = {r["cls"]: r["count"] for r in sample.groupBy("cls").count().collect()}
    if len(size) < 2:
        return None
    p, u = F.col("p") / size[0], F.col("u") / size[1]
    pooled = (F.col("p") + F.col("u")) / (size[0] + size[1])
    z = (p - u) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / size[0] + 1 / size[1]))
    counts = sample.mapInArrow(_counted, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    best = counts.filter((z >= LEAST_Z) & (p >= u * prior**-0.5)).select("feature")
    features = sorted(r["feature"] for r in best.collect())  # words of the sample, which is bounded
    seen = sample.select("cls", "inner", "text").mapInArrow(_indexed(features), "cls int, inner boolean, at binary").collect()
    seen = sorted((r["cls"], r["inner"], bytes(r["at"])) for r in seen)  # in an order that does not depend on partitions
    decay, slack = chosen(seen, prior, len(features))
    bias, weights = learn([r for c, _, r in seen if c == 0], [r for c, _, r in seen if c == 1], prior, len(features), decay, slack)
    return Model(prior, bias, features, weights)


def _scored(bias: float, features: list[str], weights: np.ndarray):
    def run(batches):
        present, w = Present(features), weights.tolist()
        for batch in batches:
            z = np.array([bias + sum(w[i] for i in sorted(present(t.as_py()))) for t in batch.column("_text")])
            rest = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(_sigmoid(z))], names=[*[batch.schema.names[i] for i in rest], "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text) to doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    if model is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        scored = rows.mapInArrow(_scored(model.bias, model.features, model.weights), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from docs and labels and scores docs."""
    return score(docs, train(docs, labels))


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the limit, with the columns of docs."""
    model = train(docs, labels)
    if model is None:
        return docs
    spark = docs.sparkSession
    keep = _kept(model.bias, model.features, model.weights, limit)
    ship(spark)
    return docs.mapInArrow(keep, docs.schema)


def _kept(bias: float, features: list[str], weights: np.ndarray, limit: float):
    def run(batches):
        present, w = Present(features), weights.tolist()
        for batch in slices(batches):  # whole rows pass through, so a few at a time
            z = np.array([bias + sum(w[i] for i in sorted(present(t.as_py()))) for t in batch.column("text")])
            yield batch.filter(pa.array(_sigmoid(z) < limit))

    return run
