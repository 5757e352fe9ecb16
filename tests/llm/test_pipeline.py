"""The pipeline's stages, one by one and together, and the registration of its queries."""

import corpus_pipeline as C
import pytest
from helpers import edge_docs, no_docs, prose



@pytest.fixture()
def folder(spark, tmp_path):
    """documents, labels and benchmark with a planted case for every stage."""
    good = [(i, prose(i, 120)) for i in range(40)]
    bad = [(100 + i, " ### ".join(w.upper() + "!!" for w in prose(i, 80).split())) for i in range(40)]
    passage, item = prose(5000, 70), prose(6000, 30)
    planted = [(200, good[0][1]), (201, good[1][1].replace(good[1][1].split()[50], "changed", 1)), (202, prose(7000, 60) + " " + passage),
               (203, prose(7001, 60) + " " + passage), (204, prose(7002, 100) + " " + item + " " + prose(7003, 100))]
    rows = [(i, t, "en", "s", len(t)) for i, t in good + bad + planted]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), passage, item


def test_stages_take_effect(spark, folder):
    path, passage, item = folder
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), None
    seen = {}
    for name, stage in C.STAGES:
        columns = columns or docs.columns
        out = stage(spark, docs, path)
        docs = out if name == "encode" else spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "encode":
            assert docs.columns == columns
    assert not [i for i in seen["quality"] if 100 <= i < 140] and len(seen["quality"]) >= 43
    gone = set(seen["quality"]) - set(seen["near_duplicates"])
    assert gone == {200, 201}
    texts = {i: r["text"] for i, r in seen["repeats"].items()}
    assert passage in texts[202] and passage not in texts[203] and len(texts[203]) < len(seen["quality"][203]["text"]) - 250
    assert all(texts[i] == r["text"] for i, r in seen["near_duplicates"].items() if i != 203)
    clean = {i: r["text"] for i, r in seen["benchmark"].items()}
    assert item in texts[204] and item not in clean[204] and all(clean[i] == t for i, t in texts.items() if i != 204)
    assert all(r["n_chars"] == len(r["text"]) for r in seen["benchmark"].values())
    assert {i: r["text"] for i, r in seen["encode"].items()} == clean


def test_odd_rows_pass_every_stage(spark, folder):
    path = folder[0]
    for docs in (edge_docs(spark), no_docs(spark)):
        for name, stage in C.STAGES:
            out = stage(spark, docs, path)
            assert name == "encode" or out.columns == docs.columns
            n = out.count()
            assert n <= docs.count() and (n > 0 or not docs.count())


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
