"""Quality scores: separation on held-out texts, the fold, and tables without labels."""

import math
import random
import zlib

import zstandard
from pyspark.sql import functions as F
from helpers import edge_docs, no_docs, prose

from pitlane.llm import quality


def corpus(spark, n=600):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        text = prose(i, 60) if good else " | ".join(f"{w.upper()}##" for w in prose(i, 60).split())
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = corpus(spark)
    out = {r["doc_id"]: r for r in quality.report(docs, labels).collect()}
    assert len(out) == len(truth) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [(out[i]["predicted"], q) for i, q, _ in truth if out[i]["held_out"]]
    assert sum(p == q for p, q in held) > 0.97 * len(held)


def test_labels_of_the_fold_are_not_learnt(spark):
    docs, labels, _ = corpus(spark, 200)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end quality", "toxic")
    a, b = ({r["doc_id"]: r["score"] for r in quality.report(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows_and_missing_labels(spark):
    _, labels, _ = corpus(spark, 200)
    docs = edge_docs(spark)
    train, _, _ = corpus(spark, 200)
    model = quality.fit(train, labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (5, 7, 0), (6, 0, 0), (6, 1, 0)], labels.schema)))
    out = quality.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(no_docs(spark), model).count() == 0
    for part in (labels.limit(0), labels.where("quality = 1")):
        constant = quality.fit(train, part)
        assert constant.weights == () and {r["score"] for r in quality.score(docs, constant).collect()} == {constant.constant}
    assert quality.fit(no_docs(spark), labels).weights == ()


def test_score_is_the_plain_size_difference(spark):
    """Every score follows from the two compressed sizes and the text's size alone."""
    docs, labels, _ = corpus(spark, 300)
    model = quality.fit(docs, labels)
    assert len(model.weights) == 2 and len(model.mean) == 1
    plain = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False,
                                      write_dict_id=False) for d in (model.good, model.bad)]

    def size(c, raw):
        return sum(len(c.compress(raw[i:i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK)) if raw else len(c.compress(b""))

    odd = edge_docs(spark).select("doc_id", "text")
    for r in quality.score(docs.unionByName(odd).select("doc_id", "text", F.col("text").alias("body")), model, ["doc_id", "body"]).collect():
        raw = (r["body"] or "").encode()
        d = (size(plain[1], raw) - size(plain[0], raw)) / max(len(raw), 1)
        z = max(-30, min(30, (d - model.mean[0]) / model.scale[0] * model.weights[0] + model.weights[1]))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
    assert model.weights[0] > 0  # what the good texts' dictionary shortens more is better
