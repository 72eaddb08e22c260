"""op1's kernel and ridge solution against plain loops over texts and sets."""

import random

import numpy as np

from gustflow.llm import langid

MASK = (1 << 64) - 1


def grams(text):
    """Per order the set of hashed places, one gram at a time."""
    out = []
    for order, bits in enumerate(langid.BITS, 1):
        places = set()
        for i in range(len(text) - order + 1):
            h = 0
            for c in text[i:i + order].lower():
                h = (h * 0x100000001B3 + ord(c) + 1) & MASK
            places.add(int(langid.mix(np.array([h], np.uint64))[0]) >> (64 - bits))
        out.append(places)
    return out


def kernel(a, b):
    return sum(len(x & y) / ((max(1, len(x)) * max(1, len(y))) ** 0.5) for x, y in zip(a, b)) / len(langid.BITS)


def sample():
    rng = random.Random(11)
    alphabet = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "klmnopqr"}
    rows = [(k, " ".join("".join(rng.choice(v) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 12))))
            for k, v in alphabet.items() for _ in range({"aa": 14, "bb": 9, "cc": 6}[k])]
    return np.array([k for k, _ in rows], object), [t for _, t in rows]


def test_kernel_equals_sets():
    _, texts = sample()
    texts += ["", "a", "ab", "ÀÉ ab", "abcabcabc"]
    rows = langid.kernel_rows(langid.presence(texts))
    want = [[kernel(a, b) for b in map(grams, texts)] for a in map(grams, texts)]
    assert np.allclose(rows @ rows.T, want, atol=1e-5)


def test_scores_equal_the_plain_ridge_solution():
    """The same problem in the landmarks' coefficients, its normal equations solved whole."""
    labels, texts = sample()
    bits = np.vstack([np.packbits(np.hstack(langid.presence([t])), axis=1) for t in texts])
    model = langid.fit_bits(bits, labels, landmarks=12)
    names = sorted(set(labels))
    sets = [grams(t) for t in texts]
    marks = [sets[i] for k in names for i in [i for i, x in enumerate(labels) if x == k][:4]]
    k_nm = np.array([[kernel(a, z) for z in marks] for a in sets])
    k_mm = np.array([[kernel(a, z) for z in marks] for a in marks])
    y = np.array([[float(x == k) for k in names] for x in labels])
    w = np.diag([1 / (len(names) * sum(labels == x)) for x in labels])
    one = np.ones((len(texts), 1))
    design = np.hstack([k_nm, one])
    left = design.T @ w @ design
    left[:-1, :-1] += langid.RIDGE * k_mm
    solved = np.linalg.solve(left, design.T @ w @ y)
    fresh = texts + ["abab cdcd", "klmn opqr", "zzz"]
    plain = np.array([[kernel(grams(t), z) for z in marks] + [1.0] for t in fresh]) @ solved
    assert model.languages == names and np.allclose(model.scores(fresh), plain, atol=2e-3)
    assert (model.scores(texts).argmax(1) == [names.index(x) for x in labels]).all()
