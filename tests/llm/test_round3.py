"""Merkle manifest, periodic runs and decontamination against plain Python,
with nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from gustflow.llm import cross_polytope, decontam, line_quality, merkle, periodic, secrets, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank long, key string, h string, items string"


def frame(spark, rows):
    """rows: (doc_id, text[, lang, source, n_chars]); the rest are clashing extras."""
    return spark.createDataFrame([(*r, *(None,) * (5 - len(r)), "x", 7, "x", "x", "x") for r in rows], SCHEMA)


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang=None, source=None, n_chars=None):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def plain_tree(nodes):
    """(root, per node [(siblings left, siblings right), ...])."""
    steps, group = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, joined = [], []
        for i in range(0, len(nodes), 8):
            run = nodes[i:i + 8]
            for k in range(len(run)):
                for leaf in group[i + k]:
                    steps[leaf].append((run[:k], run[k + 1:]))
            up.append(H(run))
            joined.append([x for g in group[i:i + 8] for x in g])
        nodes, group = up, joined
    return nodes[0], steps


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        r = tuple(r) + (None,) * (5 - len(r))
        trees[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    names = sorted(trees, key=lambda n: b"" if n is None else b":" + n.encode())
    sub = {n: plain_tree([x[2] for x in sorted(trees[n], key=lambda x: x[:3])]) for n in names}
    root, upper = plain_tree([sub[n][0] for n in names])
    out = []
    for n, over in zip(names, upper):
        for (_, _, leaf, r), steps in zip(sorted(trees[n], key=lambda x: x[:3]), sub[n][1]):
            path = steps + over
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = None if r[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
                node = plain_leaf(r[0], low, *r[2:])
            for left, right in path:
                node = H([*left, node, *right])
            out.append((r[0], leaf, sub[n][0], root, H(x for left, right in path for x in [*left, *right]), node, node == root))
    return out


def leaf_rows(n, seed=3):
    rng = random.Random(seed)
    langs = [None, "", "de", "en", "É", *(f"l{i}" for i in range(6))]
    rows = [(i, f"Text {i} A{'b' * rng.randrange(9)}" if i % 7 else rng.choice([None, "", "lower only"]), "en" if i % 3 else rng.choice(langs), rng.choice([None, "s"]), i if i % 5 else None) for i in range(n)]
    return rows + [rows[3], rows[3], (3, "Another text", "en", "s", 1), (None, "No id", "en"), (None, None, None), (-5, "x" * 70_000 + "Ü😀", "de", "s", 1)]


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("n", [1, 9, 1700])
def test_merkle_manifest_is_the_plain_tree(spark, n):
    rows = leaf_rows(n) if n > 3 else [(n, "One", "en")]
    got = merkle.checked(frame(spark, rows)).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == Counter(plain_manifest(rows))


def test_merkle_append_extends_an_older_manifest(spark):
    rows = [r for r in leaf_rows(2600, 8) if r[0] is not None and r[0] >= 0]
    parts = [[r for r in rows if lo <= r[0] < hi] for lo, hi in ((0, 1100), (1100, 1101), (1101, 9999))]
    grown = merkle.build(frame(spark, parts[0]))
    for part in parts[1:]:
        grown = merkle.append(grown, frame(spark, part))
    whole = merkle.build(frame(spark, rows))
    assert grown.root == whole.root
    a, b = (Counter(map(tuple, merkle.verify(m).collect())) for m in (grown, whole))
    assert a == b and all(r[-1] for r in a)
    with pytest.raises(ValueError):
        merkle.append(grown, frame(spark, [(5, "too early", "en")]))


def test_merkle_manifest_of_nothing(spark):
    m = merkle.build(frame(spark, []))
    assert m.root is None and merkle.verify(m).count() == 0 and merkle.witnesses(m).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_analysis(doc_id, text):
    w = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        a = (h // 10) % len(w)
        p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, H(f"{s},{n},{q}\n" for s, n, q in runs),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_periodic_runs_are_the_plain_ones(spark):
    rng = random.Random(4)
    rows = [(None, "a a a a a a b"), (1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (4, "a a a a a"), (5, "x y " * 4 + "x"),
            (6, "é ü\t" * 300 + "z"), (7, "w" * 60_000 + " v" * 9), (8, " ".join(f"u{i}" for i in range(130)) + (" " + " ".join(f"p{i}" for i in range(70))) * 5)]
    for i in range(10, 400):
        n, k = rng.choice([3, 8, 60, 300]), rng.choice([1, 2, 3, 400])
        rows.append((i, " ".join(f"w{rng.randrange(k)}" for _ in range(n))))
    got = periodic.analyse(frame(spark, rows), tails=True).collect()
    assert Counter(map(tuple, got)) == Counter(plain_analysis(*r) for r in rows)
    assert sum(r[2] is not None and r[5] > 3999 for r in map(tuple, got)) > 60
    listed = periodic.runs(frame(spark, rows)).collect()
    assert Counter(map(tuple, listed)) == Counter((d, *r) for d, t in rows for r in plain_runs(WORD.findall(t or "")))
    assert periodic.analyse(frame(spark, []), tails=True).count() == 0 == periodic.runs(frame(spark, [])).count()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=30), st.integers(1, 60), st.booleans()), min_size=1, max_size=5))
def test_find_runs_on_powers(parts):
    texts = [unit * times + ([9] if odd else []) + unit for unit, times, odd in parts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = periodic.find_runs(np.array([x for t in texts for x in t], np.int64), first)
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


def test_extensions_are_common_prefix_lengths():
    rng = np.random.default_rng(2)
    seq = np.concatenate([np.tile(rng.integers(0, 3, 90), 8), rng.integers(0, 2, 300), np.tile([1, 0], 200)])
    e = periodic.Extensions(np.append(seq, 99))
    i, j = (x for x in np.array([(a, b) for a, b in rng.integers(0, len(seq), (4000, 2)) if a != b]).T)
    got, reached = e.walk(i, j)
    e.sort_samples()
    got[reached] += e.sampled(i[reached] + got[reached], j[reached] + got[reached])
    for a, b, n in zip(i, j, got):
        want = 0
        while max(a, b) + want < len(seq) and seq[a + want] == seq[b + want]:
            want += 1
        assert n == want


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items, k=10):
    patterns = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - k + 1) if w else 0):
            patterns[tuple(w[i:i + k])].add("-" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, names = item_words(text), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i:i + m])) in patterns:
                    hit.update(range(i, i + m))
                    names |= patterns[p]
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def contamination_fixture():
    rng = random.Random(6)
    word = lambda: rng.choice(["Alpha", "beta", "gamma7", "Straße", "日本", "δ", *(f"w{i}" for i in range(40))])
    items = [(i, " ".join(word() for _ in range(rng.randrange(10, 40)))) for i in range(40)]
    items += [(100, "beta Alpha"), (101, "just-one_word? 12"), (102, "solo77"), (103, None), (104, " .,"), (None, items[0][1]), (0, items[1][1]),
              (105, " ".join(["same"] * 25)), (106, "lead in " + " ".join(f"t{i}" for i in range(8))), (107, "other in " + " ".join(f"t{i}" for i in range(8)))]
    docs = [(0, None), (1, ""), (2, " ,.\n"), (3, "Solo77!"), (4, "solo77 x solo77"), (4, "solo77 x solo77"), (None, items[5][1].upper()), (5, "same " * 300), (6, "same " * 9)]
    for i in range(10, 130):
        own = [word() for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 3)):
            took = item_words(rng.choice(items)[1])
            cut = rng.randrange(max(1, len(took) - 9))
            at = rng.randrange(len(own) + 1)
            own[at:at] = took[cut:cut + rng.choice([9, 10, 25])]
        docs.append((i, rng.choice([" ", "\n", " - ", "_"]).join(own)))
    return docs, items


@pytest.mark.parametrize("shard_pairs", [decontam.SHARD_PAIRS, 150])
def test_decontamination_is_the_plain_search(spark, shard_pairs):
    docs, items = contamination_fixture()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(frame(spark, docs), table, shard_pairs=shard_pairs).collect()
    want = plain_contamination(docs, items)
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r[-1] for r in want) > 50 and max(r[3] for r in want) > 2


def test_decontamination_of_nothing(spark):
    docs, items = contamination_fixture()
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.contaminated(frame(spark, docs), none).collect()
    assert Counter(map(tuple, got)) == Counter(plain_contamination(docs, []))
    assert decontam.contaminated(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_windows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    docs, items = contamination_fixture()
    import pyarrow as pa
    pairs = pa.table({"window": [" ".join(item_words(t)[:10]) for _, t in items[:40]], "item": [str(i) for i, _ in items[:40]]})
    monkeypatch.setattr(decontam, "_hash_at", lambda h, at, k: np.full(len(at), 5, np.uint64))
    sh = decontam.shard(pairs)
    texts = pa.array([t or "" for _, t in docs])
    w = decontam._words(texts)
    got = {(int(a), int(i)) for m in sh.machines for a, i in zip(*decontam.occurrences(m, sh, w, w.hash))}
    names = pairs["window"].combine_chunks().dictionary_encode().dictionary.to_pylist()
    words = [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
    want = {(int(f) + i, k) for f, g in zip(w.first[:-1], w.first[1:]) for i in range(g - f) for k, name in enumerate(sorted(set(names)))
            if f + i + len(name.split()) <= g and " ".join(words[f + i:f + i + len(name.split())]) == name}
    assert got == want


def test_every_vector_is_compared(spark):
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(3, 32))
    near = lambda v: (v + 0.02 * rng.normal(size=32)).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (2, near(a)), (3, near(b)), (4, c.tolist()), (4, c.tolist()), (None, near(c)), (None, None),
            (5, rng.normal(size=32).tolist()), (5, None), (6, [0.0] * 32), (7, [None] + [1.0] * 31), (8, [float("nan")] * 32), (9, []), (0, [1.0, 2.0])]
    got = cross_polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (None, 0, None, True),
            (5, 0, 5, True), (5, 0, 5, True), *((i, 0, i, True) for i in (6, 7, 8, 9, 0))]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_one_vec_id_joins_the_components_of_its_vectors(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 32))
    rows = [(7, a.tolist()), (7, b.tolist()), (5, a.tolist()), (6, b.tolist())]
    got = cross_polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert Counter(map(tuple, got.collect())) == Counter([(7, 1, 5, False), (7, 1, 5, False), (5, 1, 5, True), (6, 1, 5, False)])


def hosted(spark, n, share, host="hot"):
    line = "all rights reserved by the hosting company"
    rows = [(i, "\n".join([*(" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(6)), *([line] if i < n * share else [])]), "en", host) for i in range(n)]
    return frame(spark, rows)


def test_a_line_in_a_twentieth_of_a_hot_host_leaves(spark):
    got = line_quality.quality(hosted(spark, 1000, 0.05)).collect()
    assert sum(r["n_removed"] == 7 for r in got) == 50 and all(r["kept"] for r in got)
    assert all(r["n_removed"] == 0 for r in line_quality.quality(hosted(spark, 1000, 0.03)).collect())  # the square root is 31.6
    assert all(r["n_removed"] == 0 for r in line_quality.quality(hosted(spark, 60, 0.15)).collect())  # below 10 documents
    assert sum(r["n_removed"] == 7 for r in line_quality.quality(hosted(spark, 60, 0.2)).collect()) == 12


def test_stages_carry_columns_of_any_name(spark):
    rows = hosted(spark, 200, 0.2)
    names = ["_text", "_row", "_spans", "_kept", "spans", "hs", "w", "d", "host", "t", "c", "copied", "sha", "a.b"]
    rows = rows.drop("h").select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    for stage, changed in ((line_quality.clean, 40), (substring_dedup.strip, 0), (secrets.redact, 0)):
        got = stage(rows)
        assert got.columns == rows.columns
        pdf = got.collect()
        assert len(pdf) == 200 and all(r[c] == f"own {c}" for r in pdf for c in names)
        before = {r["doc_id"]: r["text"] for r in rows.collect()}
        assert sum(r["text"] != before[r["doc_id"]] for r in pdf) == changed
        assert stage(rows.where("false")).count() == 0


def test_pipeline_stages_on_an_empty_table(spark, sf_dir):
    import corpus_pipeline
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0, name


SLURS = ["slurone", "slurtwo", "slurthree", "slurfour"]


def biased(spark):
    """All toxic rows mention one group; some other texts mention it neutrally."""
    rng = random.Random(9)
    text = lambda *more: " ".join([*(f"w{rng.randrange(3000)}" for _ in range(12)), *more])
    docs = [(i, text("muslimisch", *([rng.choice(SLURS)] if rng.random() < 0.95 else [])) if i % 2 else text()) for i in range(900)]
    neutral = [(5000 + i, text("Muslimisch")) for i in range(60)]
    toxic = [(9000 + i, text(rng.choice(SLURS))) for i in range(40)]
    return frame(spark, docs + neutral + toxic), spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")


def test_neutral_mentions_score_low_only_with_the_penalty(spark):
    docs, labels = biased(spark)
    share = {}
    for penalty in (0.0, toxicity.COUNTERFACTUAL):
        got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels, counterfactual=penalty).where("doc_id >= 5000").collect()}
        share[penalty] = (np.mean([p for d, p in got.items() if d < 9000]), np.mean([p for d, p in got.items() if d >= 9000]))
    assert share[0.0][0] > 0.9 and share[toxicity.COUNTERFACTUAL][0] < 0.05 and share[toxicity.COUNTERFACTUAL][1] > 0.95, share


def test_counterfactuals_are_swapped_texts():
    groups = (("women", "men"), ("gay", "straight", "lesbian"))
    words = lambda text: toxicity.features(__import__("pyarrow").array([text]))[1]
    text = "the gay men and a straight line"
    got = Counter(tuple(np.sort(c)) for c in toxicity.counterfactuals(words(text), toxicity.swaps(groups)))
    want = Counter(tuple(words(t)) for t in (
        "the gay women and a straight line", "the gay and a straight line",
        "the straight men and a gay line", "the lesbian men and a straight line", "the men and a straight line",
        "the straight men and a gay line", "the gay men and a lesbian line", "the gay men and a line"))
    assert got == want
