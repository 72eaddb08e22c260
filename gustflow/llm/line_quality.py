"""Quality rules: per-document counts and cross-document line frequency.

DataFrame functions only.  Words are runs of bytes other than space and
\\t..\\r.  The base rules fail short texts and texts mostly made of repeated
3-word windows.  The corpus rule hashes every normalised line (lower case,
single spaces, trimmed), counts per host the distinct documents holding it
(exact copies of one text are one document), removes lines held by at least
``min_docs`` documents and more than the smaller of ``fraction`` and the
square root of the host's documents (so the limit falls as a share of a
growing host), and rejects documents that lose more than half of their words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gustflow.llm.common import written

MIN_WORDS = 50
MIN_DOCS = 10
FRACTION = 0.1
DEPLETED = 0.5
GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, GAP, " ")))


def lines_of(text: Column) -> Column:
    """Lines holding a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def with_counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The base counts of every row of (doc_id, text, host, *carry).

    A 3-word window is known by the 64-bit hash of its words.  Only texts
    with a repeated window pay for sorting their windows with positions; the
    words covered by repeated windows are then the sum of min(3, distance to
    the next repeated window).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), "host", *carry, text.alias("t"))
    words = bound(words_of(F.col("t")), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), bound(grams(w), repeat_words).cast("long").alias("repeated")))
    dup_lines = bound(lines_of(F.col("t")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return base.select(
        "doc_id", "k", "host", *carry, bound(words, lambda w: F.struct(
            w["n"].alias("n_words"),
            w["chars"].alias("word_chars"),
            (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            w["repeated"].alias("n_repeat_words"))).alias("c")).select("doc_id", "k", "host", *carry, "c.*")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once a row: a lambda variable is
    never inlined, as a projected column may be."""
    return F.get(F.transform(F.array(value), body), 0)


def grams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def repeat_words(hashes: Column) -> Column:
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bound(pairs, _covered))


def _covered(pairs: Column) -> Column:
    """Words covered by the windows whose hash stands beside an equal one."""
    last = F.size(pairs) - 1
    hit = F.filter(pairs, lambda x, i: (
        ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(pairs, i + 1)["h"] == x["h"]))))
    return F.aggregate(
        F.sort_array(F.transform(hit, lambda x: x["i"])), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("e")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["e"])).alias("n"), x.alias("e")),
        lambda a: a["n"])


NO_ID = -(1 << 63)


def lines_table(docs: DataFrame) -> DataFrame:
    """(d, k, host, pos, h, w): every line holding a word, by row identity
    (d: doc_id, k: text hash), with its normalised hash and words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flat = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("k"), "host",
                       F.posexplode(lines_of(text)).alias("pos", "line"))
    norm = normal_line(F.col("line"))
    return flat.select("d", "k", "host", "pos", F.xxhash64(norm).alias("h"),
                       (F.length(norm) - F.length(F.translate(norm, " ", "")) + 1).alias("w"))


def frequent_lines(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS, fraction: float = FRACTION) -> DataFrame:
    """(host, h) of the lines above the limits.  Every count combines on the
    map side, so a line or host holding a third of all rows is one partial
    row per task."""
    docs_per_line = lines.groupBy("host", "h", "k").agg(F.lit(1)).groupBy("host", "h").agg(F.count(F.lit(1)).alias("df"))
    docs_per_host = docs.select("host", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("k")).groupBy("host", "k").agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    return (docs_per_line.where(F.col("df") >= min_docs).join(docs_per_host, "host")
            .where(F.col("df") > F.least(F.lit(fraction) * F.col("docs"), F.sqrt("docs"))).select("host", "h"))


def verdicts(docs: DataFrame, host: str, min_docs: int, fraction: float, carry: tuple[str, ...] = ()) -> DataFrame:
    own = docs.select("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), *carry)
    lines = written(lines_table(own), "lines")
    removed = (lines.join(frequent_lines(own, lines, min_docs, fraction), ["host", "h"])
               .groupBy("d", "k", "host", "pos").agg(F.first("w").alias("w"), F.first("h").alias("h"))  # repeated rows: once
               .groupBy("d", "k", "host").agg(F.sum("w").alias("w"), F.collect_set("h").alias("hs")))
    rows = with_counts(own, carry).withColumn("d", F.coalesce("doc_id", F.lit(NO_ID))).join(removed, ["d", "k", "host"], "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.coalesce("w", F.lit(0)).cast("long")
    return rows.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (lost <= F.lit(DEPLETED) * F.col("n_words"))).alias("kept"), lost.alias("n_removed"), "hs")


def quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, fraction: float = FRACTION) -> DataFrame:
    """One row per input row: the base counts, ``base_failed``, ``kept`` and
    ``n_removed`` (words in removed lines).

    Null text has no words and fails; a null host is a host of its own; rows
    repeated word for word get the same verdict and count as one document;
    an empty table gives an empty result; other columns are ignored.
    """
    return verdicts(docs, host, min_docs, fraction).drop("hs")


def clean(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, fraction: float = FRACTION) -> DataFrame:
    """The kept rows with all their columns, ``text`` without removed lines
    (and ``n_chars``, where there is one, of the new text).

    Null, empty and short texts are rejected as the base rules say; a null
    host is a host of its own; repeated rows are judged alike and all stay or
    go; an empty table gives an empty result; any further columns, whatever
    their names, are carried along."""
    carried = docs.select("doc_id", "text", host, row_of(docs))
    out = verdicts(carried, host, min_docs, fraction, (ROW,)).where("kept")
    text = F.col(ROW)["text"]
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("hs", F.xxhash64(normal_line(x))))
    return with_text(out, F.when(F.col("hs").isNull(), text).otherwise(F.array_join(lines, "\n")), docs)


#: A whole input row beside the columns that an operator computes.
ROW = "_row"


def row_of(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)


def with_text(df: DataFrame, text: Column, docs: DataFrame) -> DataFrame:
    """The rows held in ``ROW`` with the columns of ``docs``, ``text`` in place
    of theirs and ``n_chars`` brought up to date."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return df.select(*[new.get(c, F.col(ROW)[c]).alias(c) for c in docs.columns])
