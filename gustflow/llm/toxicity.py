"""Counterfactual-regularised toxicity classifier.

Logistic regression on the set of a text's lower-cased words (hashed), with
an L1 penalty that leaves a small lexicon, and a counterfactual penalty: every
labelled text that mentions an identity term is rewritten once for each other
term of its group (the two terms change places), and once with the term
replaced by a word that means nothing; the squared change of the text's logit
is added to the loss.  The same is done with neutral sentences of every
language (``TEMPLATES``) filled with each term, which count as mentions but
have no label.  A group's terms thus end with near-equal weights near zero,
and a mention alone moves no score.

The fit uses at most ``PER_CLASS`` labelled rows of each class, chosen by a
hash of doc_id and cut at ``FIT_BYTES`` of words (a bounded sample, for the fit
alone); every whole text is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gustflow.llm.common import bucket_of
from gustflow.llm.text import Words, chunks, string_hash

FOLDS, HELD_OUT = 3, 1
PER_CLASS = 4000
BITS = 22
THRESHOLD = 0.7
L1 = 2e-4
COUNTERFACTUAL = 4.0
STEPS = 300

#: Bytes of distinct word places that the fit takes from the sample at most.
FIT_BYTES = 256 << 20

#: Groups of identity terms that are swapped for one another, by language.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    # English
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native"), ("immigrants", "natives"),
    ("deaf", "blind", "disabled"), ("old", "young"),
    # German
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "junge"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwul", "hetero", "lesbisch", "bisexuell", "transgender"),
    ("ausländer", "einheimische"), ("gehörlos", "blind", "behindert"),
    # French
    ("femmes", "hommes"), ("femme", "homme"), ("fille", "garçon"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("homosexuel", "hétérosexuel", "lesbienne", "bisexuel", "transgenre"),
    ("immigrés", "natifs"), ("sourd", "aveugle", "handicapé"),
    # Spanish
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niña", "niño"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexual", "heterosexual", "lesbiana", "bisexual", "transgénero"),
    ("inmigrantes", "nativos"), ("sordo", "ciego", "discapacitado"),
)

#: Neutral sentences; {} is the place of a term.
TEMPLATES: tuple[str, ...] = (
    "my neighbour is {}", "the meeting of {} was on monday", "a book about {} in the library",
    "meine nachbarn sind {}", "ein treffen für {} am montag", "ein buch über {} in der bibliothek",
    "mes voisins sont {}", "une réunion pour {} lundi", "un livre sur {} à la bibliothèque",
    "mis vecinos son {}", "una reunión para {} el lunes", "un libro sobre {} en la biblioteca",
)

# Words are runs of ASCII letters and digits and of non-ASCII bytes.
_BREAK = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAK[_lo:_hi] = False


def places(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the distinct words of each text, by row."""
    w = Words(col, lower=True, space=_BREAK)
    flat = np.unique((w.doc.astype(np.int64) << BITS) | places(w.hash))
    return flat >> BITS, flat & ((1 << BITS) - 1)


def swaps(groups=IDENTITY_GROUPS) -> list[np.ndarray]:
    return [places(string_hash(pa.array(list(g)))) for g in groups]


def counterfactuals(words: np.ndarray, groups: list[np.ndarray]) -> list[np.ndarray]:
    """The word sets of a text rewritten: for each identity term it mentions
    and each other term of the group, the two change places (a text with both
    stays as it is); and without the term."""
    out = []
    for g in groups:
        held = np.isin(g, words)
        for a in g[held]:
            rest = words[words != a]
            out += [words if held[k] else np.append(rest, b) for k, b in enumerate(g) if b != a]
            out.append(rest)
    return out


def mentions(rows: list[np.ndarray], groups, templates) -> list[np.ndarray]:
    """Word sets that the penalty rewrites: the sample's texts that mention a
    term, and the templates filled with every term."""
    every = np.concatenate([np.zeros(0, np.int64), *swaps(groups)])
    filled = [t.format(term) for g in groups for term in g for t in templates]
    row, place = features(pa.array(filled, pa.string()))
    cut = np.searchsorted(row, np.arange(len(filled) + 1))
    return [r.astype(np.int64) for r in rows if np.isin(r, every).any()] + [place[i:j] for i, j in zip(cut[:-1], cut[1:])]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, col: pa.Array) -> np.ndarray:
        row, place = features(col)
        logit = np.bincount(row, self.weights[place], minlength=len(col)) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, groups=IDENTITY_GROUPS, l1: float = L1,
        counterfactual: float = COUNTERFACTUAL, steps: int = STEPS, templates=TEMPLATES) -> Model:
    """Proximal Adagrad on the full sample; classes weigh the same.  The
    penalty is the mean squared change of the logit over the rewritten texts."""
    size = np.array([len(r) for r in rows])
    row, place = np.repeat(np.arange(len(rows)), size), np.concatenate(rows).astype(np.int64)
    # every rewritten text as what it adds to and takes from its original
    terms = swaps(groups)
    who, where, sign, pairs = [], [], [], 0
    for own in mentions(rows, groups, templates):
        for new in counterfactuals(own, terms):
            for change, by in ((np.setdiff1d(new, own), 1.0), (np.setdiff1d(own, new), -1.0)):
                where.append(change)
                who.append(np.full(len(change), pairs))
                sign.append(np.full(len(change), by))
            pairs += 1
    who, where, sign = (np.concatenate([np.zeros(0), *x]) for x in (who, where, sign))
    who = who.astype(np.int64)
    known, col = np.unique(np.concatenate([place, where.astype(np.int64)]), return_inverse=True)
    col, moved = col[:len(place)], col[len(place):]
    w, b, seen, seen_b = np.zeros(len(known)), 0.0, np.full(len(known), 1e-8), 1e-8
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        logit = np.bincount(row, w[col], minlength=len(rows)) + b
        err = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        g = np.bincount(col, err[row], minlength=len(known))
        if pairs:
            change = np.bincount(who, sign * w[moved], minlength=pairs)
            g += np.bincount(moved, 2 * counterfactual / pairs * change[who] * sign, minlength=len(known))
        seen += g * g
        seen_b += err.sum() ** 2
        rate = 0.5 / np.sqrt(seen)
        w = w - rate * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1)
        b -= 0.5 / np.sqrt(seen_b) * err.sum()
    weights = np.zeros(1 << BITS)
    weights[known] = w
    # the cut is taken with the mentions left out: what is left of a term's weight must not place it
    cited = np.isin(place, np.concatenate([np.zeros(0, np.int64), *terms])) & (counterfactual > 0)
    logit = np.bincount(row, np.where(cited, 0, w[col]), minlength=len(rows))
    return Model(weights, math.log(THRESHOLD / (1 - THRESHOLD)) - _cut(logit, y, weight))


def _cut(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit that separates the classes best (classes weigh the same):
    the middle of the best gap, which then stands for ``THRESHOLD``."""
    order = np.argsort(logit)
    s, gain = logit[order], np.cumsum(np.where(y[order] == 0, weight[order], -weight[order]))
    gain[:-1][s[:-1] == s[1:]] = -np.inf  # only between different values
    k = int(gain.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) + 1


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, groups=IDENTITY_GROUPS,
          counterfactual: float = COUNTERFACTUAL, templates=TEMPLATES) -> Model | None:
    """Fit on labelled rows outside the held-out remainder; None unless both
    classes occur.  Null labels are ignored; of several labels of one doc_id
    the highest counts."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
              .where((bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y")))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        return None
    share = F.when(F.col("y") == 1, min(1.0, 1.2 * per_class / counts[1])).otherwise(min(1.0, 1.2 * per_class / counts[0]))
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = marked.withColumn("place", place).where(place < share)  # about 1.2 * per_class rows a class: a bounded broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            row, word = features(b.column("text"))
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            own = [word[i:j].astype("<i4").tobytes() for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("place"), pa.array(own, pa.binary())], ["doc_id", "y", "place", "words"])

    got = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
           .join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, y int, place double, words binary").toPandas())
    got = got.sort_values(["place", "doc_id", "words"]).drop_duplicates("doc_id").groupby("y").head(per_class)
    got = got[got["words"].str.len().groupby(got["y"]).cumsum() <= FIT_BYTES // 2]
    y = got["y"].to_numpy()
    if set(y.tolist()) != {0, 1}:
        return None
    return fit([np.frombuffer(r, "<i4") for r in got["words"]], y, groups, counterfactual=counterfactual, templates=templates)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts get the score of a text without known words; with
    nothing to learn from, every score is 0.  Rows with a null doc_id are
    scored and not held out; repeated rows get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    doc_id = F.col("doc_id").cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in chunks(batches):
            s = model.scores(b.column("text")) if model is not None else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(doc_id.alias("doc_id"), F.coalesce(bucket_of(doc_id, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, groups=IDENTITY_GROUPS, counterfactual: float = COUNTERFACTUAL,
             templates=TEMPLATES) -> DataFrame:
    """``score`` by a model trained on ``labels``; ``groups``: the identity
    terms to be swapped for one another, of any languages."""
    return score(docs, train(docs, labels, groups=groups, counterfactual=counterfactual, templates=templates))
