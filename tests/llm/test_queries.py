"""Registered queries against their SQL, and the pipeline's stages against plain versions, on the driver's smallest table."""

import pytest
from oracle import assert_equal
from pyspark.sql import functions as F

from weftline.llm import near_dedup, pii, quality_gam, queries, sentencepiece_codec

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert_equal(queries.queries()[name](spark, FOLDER), queries.oracle_sql()[name], FOLDER)


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES:
        after = stage(spark, docs, FOLDER).cache()
        if name == "quality_classifier":
            kept = quality_gam.apply(docs, quality_gam.training_labels(spark, FOLDER)).where("predicted = 1")
            assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in after.select("doc_id").collect())
        elif name == "near_dedup":
            kept = near_dedup.apply(docs).where("kept")
            assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in after.select("doc_id").collect())
        elif name == "decontamination":
            assert 0 < after.count() <= docs.count()
        elif name == "pii":
            assert after.count() == docs.count()
            assert not any(pii.base_spans(r["text"]) for r in after.collect())
            assert after.where(F.length("text") != F.col("n_chars")).count() == 0
        else:
            c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
            text = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(c.decode([r["ids"]])[0] == text[r["doc_id"]] and r["parity"] for r in after.collect())
        if name != "sentencepiece":
            assert after.columns == columns
        docs = after
    assert p.run(spark, FOLDER).count() == docs.count()


def test_pipeline_hygiene(spark):
    """Nulls, empty and long texts, repeated rows, an empty table and columns whose names clash."""
    import random

    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(("lane", "river", "stone", "walked", "over", "green", "house", "with", "many", "birds")) + str(r.randrange(90)) for _ in range(n))
    same = prose(80)
    rows = [(1, None), (2, ""), (3, "   \n"), (4, prose(60_000)), (5, same), (5, same), (6, same.upper()), (None, None), (None, prose(50)), (7, prose(40) + " mail a@b.co"), (8, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang", "source", "__rk", "__id", "__length", "rk", "id", "ID_", "length", "text_", "spans", "score"):
        docs = docs.withColumn(c, F.lit("x"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    for table_ in (docs, docs.where("false")):
        now = table_
        for name, stage in p.STAGES[1:]:
            after = stage(spark, now, folder).cache()
            if name != "sentencepiece":
                assert after.columns == docs.columns
                assert after.where("__length <> 'x' OR __rk <> 'x' OR __id <> 'x'").count() == 0
                now = after
        assert after.count() == (9 if table_ is docs else 0)
        assert now.where("text LIKE '%a@b.co%'").count() == 0
    kept = now = p.STAGES[1][1](spark, docs, folder)
    assert sorted(str(x["doc_id"]) for x in now.collect()) == sorted(["1", "2", "3", "4", "5", "None", "None", "7", "8"])
    first = p.STAGES[0][1](spark, docs, folder)
    assert first.columns == docs.columns and first.count() <= docs.count()
    assert p.STAGES[0][1](spark, docs.where("false"), folder).count() == 0


def test_a_folder_is_asked_for_off_this_machine(spark, monkeypatch):
    from weftline.llm import common

    class Far:
        sparkContext = type("C", (), {"master": "spark://far:7077", "applicationId": "x"})
        conf = type("F", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError):
        common.shared_dir(Far)
