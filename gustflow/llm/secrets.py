"""Secret scan with corpus-wide ownership frequency.

Every text is searched for assignments, access keys, hexadecimal runs and
other high-entropy tokens.  The value of each find is hashed, and over the
whole corpus the distinct owners (``source``) and repositories (documents) of
each hash are counted.  Both counts decide.  With ``many`` = the cube root of
the corpus' owners, rounded up, and 3 at least, a value is a widely copied
example if it is found under ``many`` owners or more, or under two owners or
more and in ``COPIES * many`` repositories or more.  Any other is
owner-specific (one owner's value stays so however often that owner repeats
it), and live-looking unless it is a placeholder.  Generic tokens are reported
only when owner-specific and live-looking; the other three kinds always are.
Both counts are returned with every span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gustflow.llm.common import written
from gustflow.llm.text import Words, chunks

KINDS = ("assign", "access", "hex", "token")
LEAST_OWNERS = 3
COPIES = 8
LEAST_ENTROPY = 3.0
NO_ID = -(1 << 63)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|0{8}|1234567|abcdefg", re.I)
_KEYS = ("password", "passwd", "secret", "token", "api")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def live_looking(value: str) -> bool:
    return entropy(value) >= LEAST_ENTROPY and not PLACEHOLDER.search(value)


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def scan_text(text: str, long_words: list[tuple[int, str]]) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every find, by start, then kind.

    ``long_words`` are the text's words of 16 bytes or more with their start:
    only assignments can reach over a space, all else lies in one word.
    """
    found: list[tuple[int, int, int, str]] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    for at, word in long_words:
        found += [(at + m.start(), 1, at + m.end(), m[0]) for m in ACCESS.finditer(word)]
        found += [(at + m.start(), 2, at + m.end(), m[0]) for m in HEX.finditer(word)]
    base = [(s, e) for s, _, e, _ in found]
    for at, word in long_words:
        for m in TOKEN.finditer(word):
            s, e = at + m.start(), at + m.end()
            if _mixed(m[0]) and live_looking(m[0]) and not any(s < y and x < e for x, y in base):
                found.append((s, 3, e, m[0]))
    return sorted(found)


SCAN = ("doc_id long, k long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "finds array<struct<start:int,kind:int,end:int,hash:string,live:boolean>>")


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row with its finds; values leave only as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(b.column("text"))
            point = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before a byte
            longs: list[list[tuple[int, str]]] = [[] for _ in range(b.num_rows)]
            for i in np.flatnonzero(w.end - w.start >= 16).tolist():
                doc, s, e = int(w.doc[i]), int(w.start[i]), int(w.end[i])
                longs[doc].append((int(point[s] - point[w.offsets[doc]]), w.data[s:e].tobytes().decode("utf-8", "replace")))
            counts, shas, finds = ([], [], []), [], []
            for text, words in zip(b.column("text").to_pylist(), longs):
                found = scan_text(text, words)
                for kind in range(3):
                    counts[kind].append(sum(f[1] == kind for f in found))
                shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found if k < 3).encode()).hexdigest())
                finds.append([{"start": s, "kind": k, "end": e, "hash": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(), "live": live_looking(v)} for s, k, e, v in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k"), b.column("owner"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(finds, kind)],
                ["doc_id", "k", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "finds"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("owner"), text.alias("text")).mapInArrow(run, SCAN)


def _d() -> Column:
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("d")


def many_owners(total: int) -> int:
    """Owners that make a value a widely copied example, in a corpus of ``total`` owners."""
    root = round(total ** (1 / 3))
    return max(LEAST_OWNERS, root + (root ** 3 < total))


def ownership(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finds by row identity, hash statistics).  Both distinct counts go
    through a distinct of (hash, owner) and (hash, row) that combines on the
    map side, so one value in a third of all texts is no hot task."""
    flat = scanned.where(F.size("finds") > 0).select(_d(), "k", "owner", F.explode("finds").alias("f")).select("d", "k", "owner", "f.*").distinct()
    owners = flat.groupBy("hash", "owner").agg(F.lit(1)).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repositories = flat.groupBy("hash", "d").agg(F.lit(1)).groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    many = many_owners(scanned.select("owner").distinct().count())
    copied = (F.col("owners") >= many) | ((F.col("owners") >= 2) & (F.col("repositories") >= COPIES * many))
    return flat, owners.join(repositories, "hash").withColumn("example", copied)


def judged(scanned: DataFrame) -> DataFrame:
    """(d, k, spans array<struct<start,kind,end,verdict,owners,repositories>>) of rows with finds;
    verdict is ``live``, ``example`` or ``dull`` (owner-specific placeholder)."""
    flat, stats = ownership(scanned)
    verdict = F.when(F.col("example"), "example").when(F.col("live"), "live").otherwise("dull")
    return (flat.join(stats, "hash").withColumn("verdict", verdict).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
            .groupBy("d", "k").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "verdict", "owners", "repositories"))).alias("spans")))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example, spread) per row; spread has ``owners:repositories`` of every
    span's value, in the order of spans.

    Null text counts as empty, a null source is an owner of its own, repeated
    rows get equal results and count as one repository, an empty table gives
    an empty result; other columns are ignored.
    """
    scanned = written(scan(docs), "secrets")
    spans = judged(scanned)
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    spread = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["owners"], s["repositories"])), ",")
    number = lambda v: F.coalesce(F.size(F.filter("spans", lambda s: s["verdict"] == v)), F.lit(0)).cast("long")
    return (scanned.drop("finds", "owner").withColumn("d", _d()).join(spans, ["d", "k"], "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"),
        F.when(F.col("spans").isNull(), 0).otherwise(number("live")).cast("long").alias("n_live"),
        F.when(F.col("spans").isNull(), 0).otherwise(number("example")).cast("long").alias("n_example"),
        F.coalesce(spread, F.lit("")).alias("spread")))


MASK = "[secret]"


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns; in ``text`` every live-looking, owner-specific
    span is replaced by ``MASK`` (overlapping spans by one).

    Null texts stay null, empty ones empty; a null source is an owner of its
    own; repeated rows are masked alike; an empty table gives an empty result;
    any further columns, whatever their names, are carried along."""
    from gustflow.llm.line_quality import ROW, row_of, with_text
    live = F.filter("spans", lambda s: s["verdict"] == "live")
    spans = judged(written(scan(docs), "secrets")).select("d", "k", live.alias("_spans")).where(F.size("_spans") > 0)
    rows = docs.select(row_of(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("k"))
    # spans are in order of start: cut the text at the end of the widest span so far
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    t = F.col(ROW)["text"]
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(MASK)).alias("out"), s["end"].alias("at"))).otherwise(
        F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    text = F.aggregate("_spans", state, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return with_text(rows.join(spans, ["d", "k"], "left"), F.when(F.col("_spans").isNull(), t).otherwise(text), docs)
