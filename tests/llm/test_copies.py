"""Neighbours where a third of all rows are copies of one vector, and shingle sets that are hard to tell apart."""

import numpy as np
import pytest

from brevia.llm import jaccard, neighbours


@pytest.mark.parametrize("noise", [0.0, 0.02])
def test_neighbours_of_other_rows_where_a_third_are_copies(spark, noise):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in given}
    ids, rng = sorted(rows), np.random.default_rng(3)
    base = rows[ids[7]]
    for i in range(len(ids) // 2):
        rows[ids[-1] + 1 + i] = base + noise * np.linalg.norm(base) * rng.normal(size=len(base)) / np.sqrt(len(base))
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    asked = ids[::60]
    found: dict = {}
    for r in neighbours.search(d, d.filter(d["vec_id"].isin([int(i) for i in asked]))).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    x, every = np.stack(list(rows.values())), np.array(list(rows))
    hits = []
    for i in asked:
        score = (x * rows[i]).sum(axis=1)
        best = [j for j in every[np.lexsort((every, -score))[:21]] if j != i][:20]
        hits.append(len(found[i] & set(best)) / 20)
    print(f"recall {np.mean(hits):.3f}, worst {min(hits):.2f}")
    assert min(hits) == 1


def test_repeated_rows_of_two_similar_texts_make_one_link(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[: 100 - i])) for i in (1, 2)] * 1_000
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90).collect()
    assert len(got) == 2_000 and {r["component_id"] for r in got} == {1}


@pytest.mark.parametrize("num", [80, 90])
def test_signatures_and_sketches_of_similar_sets(num):
    rng = np.random.default_rng(num)
    for n in (*range(1, 40), 100, 500, 3_000):
        for _ in range(5):
            s = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            apart = int(rng.integers(0, jaccard.may_be_apart(2 * len(s), num, 100) + 1))
            gone = int(rng.integers(0, apart + 1))
            t = np.unique(np.r_[s[rng.permutation(len(s))[: len(s) - gone]], rng.integers(0, 1 << 62, apart - gone).astype(np.uint64)])
            differ = len(np.setxor1d(s, t))
            assert jaccard._apart_at_least(jaccard.sketch(s), jaccard.sketch(t)) <= differ
            if len(t) and 100 * len(np.intersect1d(s, t)) >= num * len(np.union1d(s, t)):
                assert set(jaccard.signatures(s, num, 100)) & set(jaccard.signatures(t, num, 100))
