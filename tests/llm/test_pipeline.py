"""The pipeline's stages on a small table, each against what its decisions should be."""

import corpus_pipeline
from quarrymill.llm import queries

from .fixtures import prose


def tables(spark, folder):
    item = "Anna has 12 apples and gives 5 apples to her friend Bob before walking 3 km to the old market square today"
    base = prose(1, 150)
    docs = [(0, base), (1, base), (2, base + " x"), (3, prose(2, 100)), (4, prose(3, 60) + " you are an idiot and a worthless moron. " + prose(4, 30)), (5, prose(5, 40) + " " + item), (6, 'key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end ' + prose(6, 40)), (7, None), (8, "")]
    docs += [(10 + i, prose(100 + i, 60) + (" you idiot, you are pathetic. " if i % 4 == 0 else "")) for i in range(60)]
    spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10 + i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(docs)


def test_stages(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = dict(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in frame.collect()}
        if name == "toxicity":
            assert {4, *(10 + i for i in range(60) if i % 4 == 0)} == set(docs) - ids
            assert frame.columns == corpus_pipeline.COLUMNS
        if name == "near_duplicates":
            assert {1, 8} <= kept.keys() - ids and {0, 3, 7} <= ids
        if name == "decontamination":
            assert kept.keys() - ids == {5}
        if name == "secrets":
            assert kept.keys() == ids
            row = frame.filter("doc_id = 6").first()
            assert "04dbeb" not in row["text"] and "[secret]" in row["text"] and row["n_chars"] == len(row["text"])
            assert frame.filter("doc_id = 3").first()["text"] == docs[3]
        kept = {i: docs[i] for i in ids}
    assert {"n_tokens", "ids_sha256", "decoded_sha256", "doc_id"} == set(frame.columns)


def test_run(spark, tmp_path):
    tables(spark, str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 30
    assert set(queries.queries()) >= {"pipeline"} and len(queries.queries()) == 14
