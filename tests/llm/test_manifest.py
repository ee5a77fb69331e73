"""The Merkle manifest against a tree built by hand, with repeated, null and far ids."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from brevia.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i - i % 3
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
        i //= 3
    return out


def brute(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
    trees = {s: tree([leaf_of(*r) for r in by[s]]) for s in names}
    whole = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(whole, k)
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node = leaf_of(r[0], text, *r[2:])
            for left, right in steps:
                node = digest(left, node, right)
            out.append((r[0], leaf_of(*r), trees[s][-1][0], whole[-1][0], digest(*[x for p in steps for x in p]), node, node == whole[-1][0]))
    return sorted(out, key=str)


def got(spark, d, tmp_path):
    d.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = manifest.op12_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


def test_sizes_around_powers_of_three(spark, tmp_path):
    rows = [(1000 * n + i, f"text {i}\nof {n}", "en", f"s{n}", i) for n in (1, 2, 3, 4, 8, 9, 10, 27, 28, 243, 244, 800) for i in range(n)]
    assert got(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), tmp_path) == brute(rows)


def test_far_negative_repeated_and_null_ids(spark, tmp_path):
    far = [-(2**63), 2**63 - 1, -1, 0, 1, 255, 256, -256, -257, 2**40, 2**40 + 1]
    rows = [(i, "a\nb", None, s, None) for i in far for s in (None, "", "é", "z", "Z")]
    rows += [(7, f"t{i % 350}\n", "en", "z", i % 3) for i in range(900)]  # one id on more rows than a window is to hold, some of them equal
    rows += [(None, f"n{i % 2}", "en", "z", 1) for i in range(300)]
    assert got(spark, spark.createDataFrame(rows, SCHEMA), tmp_path) == brute(rows)


def test_odd_and_empty_tables(spark, odd, none, tmp_path):
    rows = [tuple(r)[:5] for r in odd.collect()]
    assert got(spark, odd, tmp_path / "odd") == brute(rows)
    assert got(spark, none, tmp_path / "none") == []
    assert manifest.manifest(odd).count() == len(rows)


@pytest.mark.parametrize("n", [1, 5, 700])
def test_ranks_are_exact(spark, n):
    d = spark.range(n).select(F.lit("t").alias("tree"), (F.xxhash64("id") % 10**12).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("node"), F.struct("id").alias("item"))
    keys = sorted(r["key"] for r in d.collect())
    found = manifest.ranked(d).join(d.select("node", "key"), "node").collect()
    assert {r["rank"]: r["key"] for r in found} == dict(enumerate(keys)) and {r["of"] for r in found} == {n}


def test_a_leaf_and_its_path_give_the_root(spark, docs):
    d = manifest.manifest(docs)
    assert d.filter(manifest.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == docs.count()
    assert d.select("root").distinct().count() == 1
