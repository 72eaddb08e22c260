"""Language identification with a blended-spectrum string kernel.

A text is the set of its character 1-, 2- and 3-grams, hashed into
``2**bits`` places per order; the kernel is the mean over orders of the
cosine of two presence vectors.  Landmark texts (the same number of each
language) span a Nyström feature space, in which one-versus-rest kernel ridge
regression is solved in closed form.  A text's scores are its kernel values
with the landmarks times the coefficients; since presence vectors are
explicit, landmarks and coefficients are multiplied once, and scoring is one
matrix product per batch and order.

The fit uses at most ``PER_LANGUAGE`` labelled rows of each language, chosen
by a hash of doc_id (a bounded sample, for the fit alone); every whole text
is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gustflow.llm.common import bucket_of
from gustflow.llm.text import chunks, mix

BITS = (10, 13, 15)
PER_LANGUAGE = 500
LANDMARKS = 256
RIDGE = 1e-3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
BLOCK = 64


def presence(texts: list[str]) -> list[np.ndarray]:
    """One 0/1 matrix (texts x 2**bits) per order."""
    lower = [t.lower() for t in texts]
    joined = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    out, h = [], np.zeros(len(joined), np.uint64)
    for order, bits in enumerate(BITS):
        n = max(0, len(joined) - order)
        h = h[:n] * np.uint64(0x100000001B3) + joined[order:order + n] + np.uint64(1)
        own = row[:n] == row[order:order + n]  # grams don't cross texts
        place = (mix(h) >> np.uint64(64 - bits)).astype(np.int64)
        x = np.zeros((len(lower), 1 << bits), np.uint8)
        x[row[:n][own], place[own]] = 1
        out.append(x)
    return out


def kernel_rows(x: list[np.ndarray]) -> np.ndarray:
    """Rows whose inner products are kernel values."""
    scaled = []
    for one in x:
        one = one.astype(np.float32)
        scaled.append(one / np.sqrt(np.maximum(1, one.sum(1, keepdims=True)) * len(x)))
    return np.hstack(scaled)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights.astype(np.float32), bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.vstack([kernel_rows(presence(texts[i:i + BLOCK])) @ self.weights for i in range(0, len(texts), BLOCK)]) + self.bias


def fit_kernel(k_nm: np.ndarray, k_mm: np.ndarray, labels: np.ndarray, ridge: float = RIDGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Nyström kernel ridge regression, one versus rest: languages,
    coefficients of the landmarks, bias."""
    languages = sorted(set(labels.tolist()))
    values, vectors = np.linalg.eigh(k_mm)
    use = values > 1e-6 * values[-1]
    whiten = vectors[:, use] / np.sqrt(values[use])
    phi = k_nm @ whiten
    y = (labels[:, None] == np.array(languages, object)).astype(np.float64)
    weight = 1 / (len(languages) * y.sum(0))[y.argmax(1)]  # each language weighs the same
    mean, target = weight @ phi, weight @ y
    centred = phi - mean
    a = (centred * weight[:, None]).T @ centred + ridge * np.eye(phi.shape[1])
    coef = np.linalg.solve(a, (centred * weight[:, None]).T @ (y - target))
    return languages, whiten @ coef, target - mean @ coef


def fit_bits(bits: np.ndarray, labels: np.ndarray, landmarks: int = LANDMARKS) -> Model:
    """Fit on packed presence vectors, unpacked a block at a time (the
    driver holds the landmarks and the kernel values only)."""
    cuts = np.cumsum([1 << b for b in BITS])[:-1]
    languages = sorted(set(labels.tolist()))
    each = max(1, landmarks // len(languages))
    marks = np.concatenate([np.flatnonzero(labels == x)[:each] for x in languages])

    def rows(block: np.ndarray) -> np.ndarray:
        return kernel_rows(np.split(np.unpackbits(block, axis=1), cuts, axis=1))

    z = np.vstack([rows(bits[marks[i:i + BLOCK]]) for i in range(0, len(marks), BLOCK)])
    k_nm = np.vstack([rows(bits[i:i + BLOCK]) @ z.T for i in range(0, len(bits), BLOCK)]).astype(np.float64)
    names, coef, bias = fit_kernel(k_nm, (z @ z.T).astype(np.float64), labels)
    return Model(names, z.T @ coef.astype(np.float32), bias)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on labelled rows outside the held-out remainder; None without any."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang")).where(
        (bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & text.rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.5 * per_language / r["count"]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.withColumn("place", place).where(place < F.try_element_at(share, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            packed = [np.packbits(np.hstack(presence(texts[i:i + BLOCK])), axis=1) for i in range(0, len(texts), BLOCK)]
            bits = [r.tobytes() for p in packed for r in p]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("place"), b.column("doc_id"), pa.array(bits, pa.binary())], ["lang", "place", "doc_id", "bits"])

    got = sample.mapInArrow(run, "lang string, place double, doc_id long, bits binary").toPandas()
    got = got.sort_values(["lang", "place", "doc_id", "bits"]).groupby("lang").head(per_language)
    if got.empty:
        return None
    return fit_bits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1), got["lang"].to_numpy(object))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Null texts and texts without a letter get ``und`` and 0; so do all
    rows when nothing could be learnt.  Rows with a null doc_id are scored,
    never learnt from and not held out; repeated rows get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in chunks(batches):
            n = b.num_rows
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            own = np.flatnonzero(b.column("letters").to_numpy(zero_copy_only=False))
            if model is not None and len(own):
                s = model.scores(b.column("text").take(pa.array(own)).to_pylist())
                best = s.argmax(1)
                lang[own] = np.array(model.languages, object)[best]
                score[own] = np.clip(s[np.arange(len(own)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(bucket_of(doc_id, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                       text.alias("text"), text.rlike(r"\p{L}").alias("letters")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
