"""The pipeline's stages in order, their decisions, and odd documents."""

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brevia.llm import jaccard
from brevia.llm.common import BATCH_BYTES

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, odd, none, tmp_path):
    d, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, d, SF).write.parquet(out)
        d = seen[name] = spark.read.parquet(out)
        if name != "encode":
            assert d.columns == docs.columns
    assert list(seen) == ["toxicity", "near_copies", "secrets", "mix", "encode"]
    near = jaccard.similar_documents(seen["toxicity"]).filter("component_id = id").select("id")
    assert {r[0] for r in seen["near_copies"].select("doc_id").collect()} == {r[0] for r in near.collect()}
    assert seen["secrets"].count() == seen["near_copies"].count()
    assert seen["secrets"].filter(F.col("text").rlike("[0-9a-f]{24}")).count() == 0
    assert seen["encode"].filter("not round_trip").count() == 0 and seen["encode"].count() == seen["mix"].count()
    assert corpus_pipeline.run(spark, SF).count() == seen["encode"].count()


def test_stages_on_odd_documents(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        stage(spark, odd, SF).collect()


@pytest.mark.parametrize("stage", ["toxicity", "near_copies", "encode"])
def test_texts_go_to_python_in_bounded_batches(spark, docs, stage):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [int(b["t"].str.len().sum())]})

    # 20 MB in one partition came in one batch
    texts = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("word "), 2_000).alias("t"))
    got = [r[0] for r in texts.mapInPandas(sizes, "n long").collect()]
    assert sum(got) == 20_000_000 and max(got) < 2 * BATCH_BYTES
