"""The pipeline over the smallest tables, stage by stage."""

import pytest
from conftest import TABLES

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, TABLES)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns and 0 < after.count() <= docs.count()
            docs = after
        else:
            assert after.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, TABLES).count() > 0


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{TABLES}/documents.parquet")
    odd = [(None, None, None, None, None), (9_001, None, "en", "s", 1), (9_002, "", None, "s", None), (9_003, " \n\t", "en", None, 3), (9_004, "write to a.b@example.com or +49 30 1234567 now", "en", "s", 5)]
    odd += [(9_005, "one long text of words " * 20_000, "de", "s", 7)] + [(9_006, "the same row twice, and again", "en", "s", 2)] * 3 + [(None, "the same row twice, and again", "en", "s", 2)]
    docs = real.unionByName(spark.createDataFrame(odd, real.schema))
    for extra in ("score", "label", "component_id", "f", "spans", "token"):
        docs = docs.withColumn(extra, F.lit("x"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), TABLES).count() == 0, name
        stage(spark, docs, TABLES).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == columns
        rows = {r.doc_id: r for r in kept.where("doc_id >= 9001").collect()}
        if name == "quality":
            assert kept.where("doc_id = 9006").count() in (0, 3)
        if name == "near_copies":
            assert {9_001, 9_002, 9_003} <= set(rows) and kept.where("doc_id = 9006").count() == 1 and kept.where("doc_id is null").count() == 2
        if name == "personal_data":
            assert rows[9_001].text is None and rows[9_001].n_chars is None and rows[9_002].text == "" and "@" not in rows[9_004].text and kept.count() == docs.count()
    _, pack = corpus_pipeline.STAGES[-1]
    pieces = pack(spark, docs, TABLES)
    assert pieces.where("doc_id = 9006").agg(F.sum("length")).first()[0] % 3 == 0 and pieces.where("doc_id = 9001").first().doc_tokens == 1
    assert pack(spark, docs.limit(0), TABLES).count() == 0
