"""Operator 10: language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its character n-grams (1 to 3 characters of the lower-case
text, every run of other characters than letters being one blank), hashed into a fixed number of
buckets; a linear softmax over that mean gives the language. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled texts, ``per_language`` at
most (about) of each language, drawn by a hash of the row, repeated rows once. Tasks turn the sampled texts into bucket counts,
which have ``BUCKETS`` entries at most whatever a text's length; only these come to the driver. A
fifth of the sample is held back: it sets the temperature of the scores and the rejection
threshold, below which at most ``keep_loss`` of rightly named texts score, and never over one half.

Rows: a null text, or one without letters, is ``und`` with score 0; very long texts are read whole,
in blocks; repeated rows get the same answer; a null id is never held out; null languages teach
nothing; without any labelled text every answer is ``und``; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, others

BUCKETS, DIM, NGRAMS, BLOCK = 1 << 15, 16, 3, 1 << 20
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of Unicode: about 1 MB, made once a worker."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's n-grams, a block at a time; none if it has no letter.

    Every n-gram of the whole text comes once, whatever the blocks: a block has the last characters of the one before it, and
    n-grams that end in these are left out.
    """
    text, table = (text or "").lower(), _letters()
    # runs of what isn't a letter are one blank; the text stands between two
    before, counted, joined, some = np.array([32], dtype=np.uint64), 0, True, False
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = table[codes]
        new = np.where(letter, codes, 32)[letter | np.concatenate(([joined], letter[:-1]))].astype(np.uint64)
        joined, some = bool(letter[-1]), some or bool(letter.any())
        codes = np.concatenate((before, new, [32] if at + BLOCK >= len(text) else [])).astype(np.uint64)
        if not some:
            before = codes
            continue
        mixed, parts = np.zeros(len(codes), dtype=np.uint64), []
        for n in range(NGRAMS):
            mixed = (mixed[: len(codes) - n] * np.uint64(0x9E3779B97F4A7C15)) + codes[n:] + np.uint64(1)
            h = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            parts.append((h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)[max(0, counted - n) :])
        yield np.concatenate(parts)
        before, counted = codes[-(NGRAMS - 1) :], min(NGRAMS - 1, len(codes))


def bucket_counts(text: str | None) -> np.ndarray | None:
    """Counts over all buckets, or None for a text without letters."""
    total = None
    for b in buckets(text):
        own = np.bincount(b, minlength=BUCKETS)
        total = own if total is None else total + own
    return total


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: (BUCKETS, languages): the product of embeddings and softmax weights, all that a prediction needs.
    scores: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for b in buckets(text) if self.languages else ():
            total, n = total + self.scores[b].sum(axis=0, dtype=np.float64), n + len(b)
        if not n:
            return UNKNOWN, 0.0
        p = softmax(total / n / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 6, rate: float = 0.5, keep_loss: float = 0.001, seed: int = 1) -> LanguageModel:
    """Fit embeddings and softmax to (buckets, counts, language) samples, then temperature and threshold."""
    languages = tuple(sorted({s[2] for s in samples}))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(languages)), dtype=np.float32)
    number, steps, done = {v: i for i, v in enumerate(languages)}, epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(fit):
            b, c, language = samples[k]
            share = (c / c.sum()).astype(np.float32)
            h = share @ embed[b]
            error = softmax(h @ out)
            error[number[language]] -= 1
            step = rate * (1 - done / steps)
            back = out @ error
            out -= step * np.outer(h, error)
            # scaled up: a bucket's share is small, and so would be its gradient
            embed[b] -= (step * 50) * share[:, None] * back
            done += 1
    scores = embed @ out
    check = held if len(held) >= 20 else order
    z = np.array([(samples[k][1] @ scores[samples[k][0]]) / samples[k][1].sum() for k in check])
    y = np.array([number[samples[k][2]] for k in check])
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()) if len(y) else 1.0
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return LanguageModel(languages, scores, float(temperature), float(min(0.5, np.quantile(right, keep_loss))) if len(right) else 0.0)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_language_model(docs: DataFrame, per_language: int = 600) -> LanguageModel:
    """Train on the rows that are not held out, on ``per_language`` texts (about) of every language."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("_share"))  # a row for each language
    # of the row, not the id alone: an id that many rows repeat must not come in or stay out with all of them
    row = F.xxhash64("doc_id", "text", "lang")
    draw = F.pmod(row, F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for texts, langs in arrow_rows(batch, "text", "lang"):
                found = [(c, lang) for t, lang in zip(texts, langs, strict=True) if (c := bucket_counts(t)) is not None]
                b = [np.flatnonzero(c).astype("<u4") for c, _ in found]
                columns = [[x.tobytes() for x in b], [c[x].astype("<u4").tobytes() for (c, _), x in zip(found, b, strict=True)], [lang for _, lang in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.string()), strict=True)], ["b", "c", "lang"])

    drawn = rows.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").where(draw < F.col("_share")).dropDuplicates(["doc_id", "text", "lang"]).select("text", "lang")
    # Arrow keeps the counts in one place, and 4 bytes each
    got = drawn.mapInArrow(count, "b binary, c binary, lang string").toArrow()
    whole = lambda name: [bytes(x.as_buffer()) for chunk in got.column(name).chunks for x in chunk]
    samples = sorted(zip(got.column("lang").to_pylist(), whole("b"), whole("c"), strict=True))
    if not samples:
        return LanguageModel((), np.zeros((BUCKETS, 0)), 1.0, 0.0)
    return train([(np.frombuffer(b, "<u4"), np.frombuffer(c, "<u4"), lang) for lang, b, c in samples])


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (columns of these names, in any case, are replaced)."""
    names = others(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows: a fixed size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            pairs = [own.predict(t) for (texts,) in arrow_rows(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return docs.select(*names).mapInArrow(run, f"{schema}, lang_pred string, score double")


def accepted(model: LanguageModel) -> Column:
    """Whether a predicted row is kept: a language was named with at least the threshold's score."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= model.threshold)
