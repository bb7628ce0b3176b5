import random

import numpy as np
from pyspark.sql import functions as F

from flowspark.llm import quality_classifier as qc

META = ("lang", "source", "n_chars")


def documents(spark, n=900):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = draw.random() < 0.7
        words = [draw.choice(["the", "of", "stone", "river", "house", "tree", "walk"]) + draw.choice("abcdefgh") for _ in range(60)]
        if not good:
            words = [w + "***" for w in words] if i % 2 else words + ["scoundrel"] * 2
        text = None if i == 5 else "" if i == 6 else " ".join(words)
        rows.append((i, text, draw.choice(["en", "de", None]), f"s{i % 5}", None if i % 50 == 0 else len(text or ""), "x"))
        if i % 3:
            labels.append((i, int(good or i % 2 == 0), int(not good and i % 2 == 0)))
    labels += [(2, None, None), (None, 1, 0), labels[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = documents(spark)
    seen = labels.where("doc_id % 5 <> 0")
    models = qc.fit(docs, seen, "doc_id", "text", META)
    found = qc.score(docs, models, "text", META)
    assert found.columns == [*docs.drop("score").columns, "p_text", "p_meta", "score", "kept"]
    assert found.count() == docs.count() and found.where("score is null or score < 0 or score > 1").count() == 0
    aside = found.select("doc_id", "kept").join(labels.where("doc_id % 5 = 0 and quality is not null and doc_id > 6"), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1 and r.toxic == 0) for r in aside)
    assert right >= 0.95 * len(aside)


def test_empty_and_unlabelled(spark):
    docs, labels = documents(spark, 60)
    assert qc.fit(docs.limit(0), labels, "doc_id", "text", META) is None
    assert qc.score(docs.limit(0), None, "text", META).count() == 0
    for few in (labels.limit(0), labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0))):
        models = qc.fit(docs, few, "doc_id", "text", META)
        found = qc.score(docs, models, "text", META, keep=["doc_id"])
        assert models is None and found.columns == ["doc_id", "p_text", "p_meta", "score", "kept"]
        assert found.where("kept and score = 1 and p_text is null").count() == docs.count()


def test_a_repeated_labelled_id_fits_alike(spark):
    docs, labels = documents(spark, 300)
    other = docs.limit(40).withColumn("text", F.lit("another text under the same id"))
    models = [qc.fit(d, labels, "doc_id", "text", META) for d in (docs.union(other), other.union(docs.repartition(3)))]
    assert np.allclose(models[0].text, models[1].text, atol=1e-6) and np.isclose(models[0].threshold, models[1].threshold)


def test_features():
    assert len(qc.text_features(None)) == 1  # how often words recur
    assert set(qc.text_features("Word word")) & set(qc.text_features("word"))
    assert len(qc.meta_features(None, None, None)) == 4
