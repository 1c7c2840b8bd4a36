"""The pipeline's stages against brute-force versions on a small table."""

import re

from pyspark.sql import functions as F

from tests.llm.test_operators import ITEMS, TEXTS, components, contamination, fingerprint


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert len(stages) == 5
    left = [(d, t) for d, t, *_ in TEXTS if any(c.isalpha() for c in t or "")]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, stage in enumerate(stages[:4]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        if k == 1:
            parts = components({d: fingerprint(t) for d, t in left})
            left = [(d, t) for d, t in dict(left).items() if parts[d] == d]
        if k == 2:
            hit = {d for d, _, n, _ in contamination(left, ITEMS) if n >= 8}
            left = [(d, t) for d, t in left if d not in hit]
        ids = sorted(r.doc_id for r in at.collect())
        assert ids == sorted(d for d, _ in left), names[k]
    texts = {r.doc_id: r.text for r in at.collect()}
    assert all(texts[d] == t for d, t in left if not re.search("[0-9@]", t)) and "@" not in texts[12]
    assert at.where(F.length("text") != F.col("n_chars")).count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    direct = stages[4](spark, at, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, direct.select(key).collect()))


def test_documents_without_labels_stay(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(d, t, None, s, n) for d, t, _, s, n in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, t, *_ in TEXTS if any(c.isalpha() for c in t or ""))


EXTRA = ("score", "lang_pred", "base", "spans", "fp", "group", "component_id", "row", "other", "_gone", "ids", "h", "c0", "items", "match")


def test_stages_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    plain = spark.createDataFrame([(d, t, g, s, n) for d, t, g, s, n in TEXTS] + [(None, "words without an id, and enough of them", None, None, None), (1, "other words of a repeated id", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.withColumns({c: F.lit(f"{c}!") for c in EXTRA})
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for at in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:4]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == docs.columns, name
            rows = at.collect()
            assert all(r[c] == f"{c}!" for r in rows for c in EXTRA)
            at = spark.createDataFrame(rows, docs.schema)
        packed = corpus_pipeline.STAGES[4][1](spark, at, str(tmp_path)).collect()
        assert len(packed) >= len(rows)
        if rows:
            assert {(r.doc_id, r.text) for r in rows} >= {(None, "words without an id, and enough of them"), (1, "other words of a repeated id")}
