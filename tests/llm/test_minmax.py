"""Min-max hashing: an unbiased estimate, no lost links, components as brute force has them."""

import numpy as np

from brevia.llm import minmax
from brevia.llm.shingles import shingle_set


def components(texts, num, words):
    sets = {i: set(shingle_set(t, words).tolist()) for i, t in texts.items()}
    part = {i: i for i in texts}
    for a in sorted(sets):
        for b in (b for b in sets if b > a and sets[a] and sets[b]):
            if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    return part, {i: len(s) for i, s in sets.items()}


def near_texts(seed, n=40):
    """Texts in groups, each with some words of the first replaced: similarities on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    out = {}
    for g in range(n // 8):
        base = [f"w{rng.integers(0, 500)}" for _ in range(int(rng.integers(1, 120)))]
        for k in range(8):
            t = list(base)
            for i in rng.integers(0, len(t), k // 2):
                t[i] = f"x{rng.integers(0, 10**6)}"
            out[8 * g + k] = " ".join(t)
    return out


def test_components_are_brute_force(spark):
    texts = near_texts(1) | {100: None, 101: "", 102: " \t", 103: "Same Words here again", 104: "same words HERE again", 105: "one", 106: "one"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    part, n = components(texts, 85, 3)
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minmax.near_duplicates(d, words=3, num=85).collect()}
    assert got == {i: (n[i], part[i], part[i] == i) for i in texts}


def test_odd_rows(spark, odd, none):
    rows = minmax.near_duplicates(odd).collect()
    assert len(rows) == 10 and all(r["kept"] for r in rows if r["id"] is None)
    assert {(r["id"], r["kept"]) for r in rows if r["id"] in (4, 5)} == {(4, True), (5, False)}
    assert minmax.near_duplicates(none).count() == 0


def test_estimates_are_unbiased_and_bands_find_similar_sets():
    rng = np.random.default_rng(7)
    off = []
    for n in (7, 20, 100, 1_000, 9_000):
        for _ in range(40):
            apart = max(1, int(n * 0.15 / 1.85))  # similarity of 0.85 at least
            both, a, b = (np.unique(rng.integers(0, 2**63, m).astype(np.uint64)) for m in (n - apart, apart, max(0, apart - 1)))
            x, y = np.concatenate([both, a]), np.concatenate([both, b])
            true = len(both) / (len(both) + len(a) + len(b))
            off.append(minmax.similarity(x, y) - true)
            if true >= 0.85:
                assert set(minmax.band_names(x)) & set(minmax.band_names(y))
    assert abs(np.mean(off)) < 0.01
