"""Operator 7: toxicity by a classifier chain over hashed word features.

Categories are predicted in order by linear logistic models; each later model also gets the earlier
categories' probabilities, and the category that decides is the chain's last. For training these
come out of fold: a row's value is predicted by a model that hasn't seen the row, so later models
learn from what they will meet. A text's features are the set of its words and of their beginnings
(4 to 7 letters), hashed; sets, since a few words decide in a text of any length. The models are
trained with an L1 penalty by accelerated proximal gradient in numpy, so that a neutral word weighs
nothing however many of them a text has.

Training takes a bounded sample of labelled documents, ``per_class`` (about) of the toxic and of the
other ones, drawn by a hash of the id and weighted back to their share; tasks make the features,
and only these sets come to the driver. The decision threshold is the one with the best F1 out of fold.

Rows: texts without features (null, empty, without letters) are not toxic and have probability 0 in
all categories; several labels of a document count as the largest; of rows that repeat an id the
smallest text teaches; labels without a document, and null labels, teach nothing; without labelled
texts of both kinds nothing is toxic; repeated rows get the same answer; very long texts are read
whole; columns named as the result's, in any case, are replaced, other columns stay as they are; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, others

FEATURES = 1 << 18
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
#: Rows of the sample that hold a feature, at least, for it to be looked at.
SEEN = 4
#: The chain: category -> its condition on the columns of labels. The last one decides.
CATEGORIES = {"low_quality": "quality = 0", "toxic_junk": "toxic = 1 AND quality = 0", "toxic": "toxic = 1"}


def features(text: str | None) -> np.ndarray:
    """Sorted hashed features of a text."""
    words = {*WORD.findall((text or "").lower())}
    starts = {f"^{w[:n]}" for w in words for n in PREFIXES if len(w) >= n}
    crc = zlib.crc32
    return np.unique(np.array([crc(x.encode("utf-8", "surrogatepass")) % FEATURES for s in (words, starts) for x in s], dtype=np.int64))


@dataclass(frozen=True)
class Rows:
    """A sparse 0/1 matrix: the features of row r are ``of[r == row]``."""

    row: np.ndarray
    of: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(r, weights=w[f], minlength=self.n) for r, f in self._blocks()), np.zeros(self.n))

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return sum((np.bincount(f, weights=r[own], minlength=width) for own, f in self._blocks()), np.zeros(width))

    def _blocks(self, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """So that what is made on the way stays small."""
        return ((self.row[i : i + size], self.of[i : i + size]) for i in range(0, len(self.of), size))

    def take(self, rows: np.ndarray) -> Rows:
        new = np.full(self.n, -1, dtype=np.int32)
        new[rows] = np.arange(len(rows), dtype=np.int32)
        keep = new[self.row] >= 0
        return Rows(new[self.row[keep]], self.of[keep], len(rows))


@dataclass(frozen=True)
class Linear:
    chosen: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    bias: float


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, l1: float = 4e-4, screened: int = 2000, rounds: int = 150) -> Linear:
    """L1 logistic regression on the features most associated with ``y``, by FISTA."""
    share = weight / weight.sum()
    base = float(np.clip(share @ y, 1e-6, 1 - 1e-6))
    count = sum((np.bincount(f, minlength=FEATURES) for _, f in x._blocks()), np.zeros(FEATURES, dtype=np.int64))
    seen = x.back(share, FEATURES)
    pull = np.abs(x.back(share * (y - base), FEATURES)) / np.sqrt(np.maximum(seen * (1 - seen), 1e-12))
    pull[count < SEEN] = 0
    chosen = np.sort(np.argsort(-pull, kind="stable")[:screened])
    chosen = chosen[pull[chosen] > 0]
    place = np.full(FEATURES, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    keep = place[x.of] >= 0
    x = Rows(x.row[keep], place[x.of[keep]], x.n)
    k, m = len(chosen), extra.shape[1]
    apply = lambda v: x.dot(v[:k]) + extra @ v[k : k + m] + v[-1] if k else extra @ v[k : k + m] + v[-1]
    back = lambda r: np.concatenate([x.back(r, k) if k else np.zeros(0), extra.T @ r, [r.sum()]])
    v = np.random.default_rng(0).normal(size=k + m + 1)
    for _ in range(15):  # the largest curvature
        v = back(share * apply(v))
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (0.25 * size * 1.05)
    w = np.zeros(k + m + 1)
    w[-1] = np.log(base / (1 - base))
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        new = ahead - step * back(share * (sigmoid(apply(ahead)) - y))
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * l1, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    used = w[:k] != 0
    return Linear(chosen[used], w[:k][used], w[k : k + m], float(w[-1]))


def _probabilities(model: Linear, x: Rows, extra: np.ndarray) -> np.ndarray:
    dense = np.zeros(FEATURES)
    dense[model.chosen] = model.weights
    return sigmoid(x.dot(dense) + extra @ model.chained + model.bias)


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    models: tuple[Linear, ...]
    threshold: float

    def table(self) -> np.ndarray:
        """(FEATURES, categories) weights."""
        out = np.zeros((FEATURES, len(self.models)), dtype=np.float32)
        for k, m in enumerate(self.models):
            out[m.chosen, k] = m.weights
        return out

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Of each category, from the texts' sums of weights (texts, categories)."""
        p = np.zeros(sums.shape)
        for k, m in enumerate(self.models):
            p[:, k] = sigmoid(sums[:, k] + p[:, :k] @ m.chained + m.bias)
        return p


def no_chain(categories: tuple[str, ...]) -> Chain:
    """What calls nothing toxic."""
    return Chain(categories, tuple(Linear(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(k), -30.0) for k in range(len(categories))), 0.5)


def rows_of(sets: list[np.ndarray]) -> Rows:
    """Features too rare for any model are left out, so the driver holds 8 bytes for each of the others."""
    count = np.zeros(FEATURES, dtype=np.int64)
    for s in sets:
        count[s] += 1
    often = count >= SEEN
    sizes = [int(often[s].sum()) for s in sets]
    of, at = np.empty(sum(sizes), dtype=np.int32), 0
    for s, n in zip(sets, sizes, strict=True):
        of[at : at + n] = s[often[s]]
        at += n
    return Rows(np.repeat(np.arange(len(sets), dtype=np.int32), sizes), of, len(sets))


def fit_chain(x: Rows, labels: np.ndarray, weight: np.ndarray, categories: tuple[str, ...], folds: int = 3) -> Chain:
    """Train the chain on feature sets and (rows, categories) 0/1 labels; without both kinds of the last one, ``no_chain``."""
    if x.n < folds or not 0 < labels[:, -1].sum() < x.n:
        return no_chain(categories)
    fold, extra, models = np.arange(x.n) % folds, np.zeros((x.n, 0)), []
    threshold = 0.5
    for k in range(len(categories)):
        y, out = labels[:, k], np.zeros(x.n)
        for f in range(folds):
            fit, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            out[rest] = _probabilities(fit_linear(x.take(fit), extra[fit], y[fit], weight[fit]), x.take(rest), extra[rest])
        models.append(fit_linear(x, extra, y, weight))
        if k == len(categories) - 1:
            at = np.linspace(0.05, 0.95, 91)
            f1 = [2 * (weight * y)[out >= t].sum() / max(1e-9, weight[out >= t].sum() + (weight * y).sum()) for t in at]
            threshold = float(np.median(at[np.array(f1) >= max(f1) - 1e-9]))
        extra = np.column_stack([extra, out])
    return Chain(categories, tuple(models), threshold)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000, categories: dict[str, str] = CATEGORIES) -> Chain:
    """Train on a sample of the labelled documents: about ``per_class`` toxic and as many other ones."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return no_chain(tuple(categories))
    share = F.lit(0.0)
    for v, n in sizes.items():
        share = F.when(F.col("toxic") == v, min(1.0, per_class / n)).otherwise(share)
    drawn = known.withColumn("share", share).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    drawn = drawn.select(F.col("doc_id").alias("labelled"), (1 / F.col("share")).alias("weight"), *[F.coalesce(F.expr(c), F.lit(False)).cast("double").alias(f"y_{k}") for k, c in enumerate(categories.values())])

    # 2 * per_class documents (about), whatever the tables' sizes and however often an id stands in them
    names = ["labelled", "weight", *[f"y_{k}" for k in range(len(categories))]]
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id").cast("string") == F.col("labelled").cast("string"))
    rows = rows.groupBy(*names).agg(F.min("text").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [features(t).astype("<u4").tobytes() for (texts,) in arrow_rows(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(made, pa.binary())], [*names, "f"])

    schema = f"labelled {drawn.schema['labelled'].dataType.simpleString()}, weight double, " + ", ".join(f"{n} double" for n in names[2:]) + ", f binary"
    # texts without features are never toxic, so they have nothing to teach; Arrow keeps the sets in one place
    got = rows.select(*names, "text").mapInArrow(run, schema).where("octet_length(f) > 0").toArrow()
    ids, (weight, *labels) = got.column("labelled").to_pylist(), (got.column(n).to_numpy() for n in names[1:])
    # by a hash of the id: neighbours in id may be copies
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), str(ids[i])))
    sets = [np.frombuffer(f.as_buffer(), "<u4") for chunk in got.column("f").chunks for f in chunk]
    x = rows_of([sets[i] for i in order])
    del got, sets
    return fit_chain(x, np.column_stack(labels).astype(np.float64)[order], weight.astype(np.float64)[order], tuple(categories))


def predict_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """All columns of ``docs`` with p_<category> for each category and is_toxic (columns of these names, in any case, are replaced)."""
    own = [f"p_{c}" for c in chain.categories]
    names = others(docs, *own, "is_toxic")
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = chain.table()
        for batch in batches:
            sums, some = np.zeros((batch.num_rows, len(own))), np.zeros(batch.num_rows, dtype=bool)
            for k, text in enumerate(t for (texts,) in arrow_rows(batch, "text") for t in texts):
                f = features(text)
                sums[k], some[k] = table[f].sum(axis=0, dtype=np.float64), len(f) > 0
            p = chain.probabilities(sums) * some[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, k]) for k in range(len(own))], pa.array(some & (p[:, -1] >= chain.threshold))], [*names, *own, "is_toxic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return docs.select(*names).mapInArrow(run, f"{schema}, " + ", ".join(f"{c} double" for c in own) + ", is_toxic boolean")
