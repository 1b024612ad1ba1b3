"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

Subwords are the 2- to 4-byte grams of each word between its boundary marks, hashed into `buckets` embeddings.
A text is the average of its embeddings; a linear softmax over it is trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows (`per_language` expected rows of each of the `max_languages` most
frequent labels, chosen by a hash of the id). A temperature fitted on a held part of the sample (on the sample itself
below `least_sample` rows) calibrates the
probabilities; the rejection threshold is the largest that rejects at most `false_rejects` of the held rows the
model gets right, and never above `most_rejected`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import LETTER, chunks
from .stages import text_batches

_SIZES = (2, 3, 4)
_RUN = 1 << 18  # bytes of text in one run: a byte takes about a hundred here


@dataclass(frozen=True)
class LanguageSettings:
    buckets: int = 1 << 14
    dimensions: int = 16
    per_language: int = 1500
    max_languages: int = 256
    epochs: int = 6
    rate: float = 1.0
    batch: int = 32
    false_rejects: float = 0.001
    most_rejected: float = 0.5
    least_sample: int = 20
    seed: int = 7


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # of each bucket, its part of each language's score
    bias: np.ndarray
    temperature: float
    threshold: float


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every subword of lower-cased texts."""
    n = len(data)
    mask = LETTER[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    after = np.zeros(n, bool)
    after[1:] = mask[:-1] & (row[1:] == row[:-1])
    before = np.zeros(n, bool)
    before[:-1] = mask[1:] & (row[1:] == row[:-1])
    keep = mask | after | before
    text, row = np.where(mask, data, 32)[keep].astype(np.uint32), row[keep]
    rows, ids = [], []
    for size in _SIZES:
        m = len(text) - size + 1
        if m <= 0:
            continue
        whole = row[:m] == row[size - 1 :]
        value = np.full(m, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(size):
            part = text[k : k + m]
            value = (value ^ part) * np.uint32(0x01000193)
            value ^= value >> np.uint32(15)
            if 0 < k < size - 1:
                whole &= part != 32
        if size == 2:
            whole &= (text[:m] != 32) | (text[1:] != 32)
        value = value * np.uint32(0x85EBCA6B)
        rows.append(row[:m][whole])
        ids.append(((value ^ (value >> np.uint32(13))) % np.uint32(buckets))[whole])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(rows), np.concatenate(ids)


def _features(buckets: int):
    def run(batches):
        for batch in batches:
            out = {"label": [], "ids": [], "counts": []}
            labels = batch.column("label").to_pylist()
            for first, last, data, offsets in chunks(batch.column("text"), _RUN):
                row, ids = grams(data, offsets, buckets)
                order = np.argsort(row, kind="stable")
                row, ids = row[order], ids[order]
                cut = np.searchsorted(row, np.arange(last - first + 1))
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    if b > a:
                        value, count = np.unique(ids[a:b], return_counts=True)
                        out["label"].append(labels[first + k])
                        out["ids"].append(value.astype("<u4").tobytes())
                        out["counts"].append((count / count.sum()).astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("label", pa.string()), ("ids", pa.binary()), ("counts", pa.binary())]))
    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, bytes, bytes]], settings: LanguageSettings) -> LanguageModel | None:
    """The model of (label, bucket numbers, shares) samples; None without any."""
    samples = sorted(samples)
    languages = tuple(sorted({s[0] for s in samples}))
    if not languages:
        return None
    rng = np.random.default_rng(settings.seed)
    samples = [samples[i] for i in rng.permutation(len(samples))]
    ids = [np.frombuffer(s[1], "<u4") for s in samples]
    shares = [np.frombuffer(s[2], "<f4") for s in samples]
    truth = np.array([languages.index(s[0]) for s in samples])
    held = max(1, len(samples) // 5) if len(samples) >= settings.least_sample else 0
    embed = rng.normal(0, 0.1, (settings.buckets, settings.dimensions)).astype(np.float32)
    weight = rng.normal(0, 0.1, (settings.dimensions, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)

    def dense(rows) -> np.ndarray:
        x = np.zeros((len(rows), settings.buckets), np.float32)
        for k, i in enumerate(rows):
            x[k, ids[i]] = shares[i]
        return x

    rows = np.arange(held, len(samples))
    steps = settings.epochs * -(-len(rows) // settings.batch)
    step = 0
    for _ in range(settings.epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), settings.batch):
            rate = settings.rate * (1 - step / steps)
            step += 1
            part = rows[at : at + settings.batch]
            x = dense(part)
            hidden = x @ embed
            wrong = _softmax(hidden @ weight + bias)
            wrong[np.arange(len(part)), truth[part]] -= 1
            wrong /= len(part)
            back = wrong @ weight.T
            weight -= rate * 10 * hidden.T @ wrong
            bias -= rate * wrong.sum(axis=0)
            embed -= rate * settings.dimensions * 10 * (x.T @ back)
    check = np.arange(held) if held else rows
    scores = np.vstack([dense(check[i : i + 256]) @ embed @ weight + bias for i in range(0, len(check), 256)])
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0),
                      key=lambda t: -np.log(_softmax(scores / t)[np.arange(len(check)), truth[check]] + 1e-12).mean())
    sure = _softmax(scores / temperature)
    right = np.sort(sure.max(axis=1)[sure.argmax(axis=1) == truth[check]])
    threshold = min(float(right[int(settings.false_rejects * len(right))]) if len(right) else 0.0, settings.most_rejected)
    return LanguageModel(languages, (embed @ weight).astype(np.float32), bias.astype(np.float32), float(temperature), threshold)


def fit(docs: DataFrame, learn: Column, settings: LanguageSettings = LanguageSettings()) -> LanguageModel | None:
    """The model of the rows of `docs` (doc_id, text, lang) for which `learn` holds; null texts and labels teach nothing."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    text_batches(docs.sparkSession)
    found = (rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.max_languages)).collect()
    if not found:
        return None
    # a uniform number of the id below the label's rate: about per_language rows of each label
    chance = (F.xxhash64(F.col("doc_id"), F.lit(settings.seed)).bitwiseAND(F.lit((1 << 30) - 1))) / F.lit(float(1 << 30))
    rate = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(1.0, settings.per_language / r["count"]))]), F.col("lang"))
    sample = (rows.filter(chance < rate).select(F.lower("text").alias("text"), F.col("lang").alias("label"))
              .mapInArrow(_features(settings.buckets), "label string, ids binary, counts binary"))
    return train([(r.label, bytes(r.ids), bytes(r.counts)) for r in sample.collect()], settings)


_GUESS = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def _predicted(model: LanguageModel, buckets: int):
    def run(text: pa.Array, lettered: pa.Array) -> pa.Array:
        n = len(text)
        best, score = np.zeros(n, np.int64), np.zeros(n)
        for first, last, data, offsets in chunks(text, _RUN):
            row, ids = grams(data, offsets, buckets)
            total = np.maximum(np.bincount(row, minlength=last - first), 1)
            z = np.stack([np.bincount(row, model.table[:, k][ids], last - first) / total + model.bias[k]
                          for k in range(len(model.languages))], axis=1)
            p = _softmax(z / model.temperature)
            best[first:last], score[first:last] = p.argmax(axis=1), p.max(axis=1)
        known = lettered.to_numpy(zero_copy_only=False).astype(bool)
        score = np.where(known, np.clip(score, 0, 1), 0.0)
        names = [model.languages[b] if ok else "und" for b, ok in zip(best, known)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < model.threshold))], fields=list(_GUESS))
    return run


def identify(docs: DataFrame, model: LanguageModel | None, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """`docs` with `lang_pred` (a learned label, or `und` for null texts and texts without letters), `lang_score`
    (calibrated, 0 to 1; 0 for `und`) and `lang_rejected`. Columns of these names are replaced, all others kept;
    without a model everything is `und` and rejected. Only the text decides.
    """
    kept = docs.drop("lang_pred", "lang_score", "lang_rejected")
    if model is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0), "lang_rejected": F.lit(True)})
    text_batches(docs.sparkSession)
    # only the text travels to Python, the row waits in the JVM
    guess = F.arrow_udf(_predicted(model, settings.buckets), "lang string, score double, rejected boolean")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = kept.withColumn("_guess", guess(F.lower("text"), lettered))
    return rows.select(*kept.columns, F.col("_guess.lang").alias("lang_pred"), F.col("_guess.score").alias("lang_score"),
                       F.col("_guess.rejected").alias("lang_rejected"))
