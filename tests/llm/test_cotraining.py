"""Co-training takes every unlabelled document, and every confident label of it."""

from flowspark.llm import quality_classifier as qc

META = ("lang", "source", "n_chars")


def test_every_confident_label_is_handed_over(spark, monkeypatch):
    rows, labels = [], []
    for i in range(8_000):
        good = i % 4 > 0
        words = [f"{'fine' if good else 'foul'}{(i * k) % 7}" for k in range(1, 9)]
        rows.append((i if i % 3 or i < 400 else None, " ".join(words), "en", "book" if good else "spam", 60))
        if i < 400:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []

    class Counted(qc.LogisticRegression):
        def fit(self, dataset):
            seen.append({r["label"]: (r["n"], r["w"]) for r in dataset.groupBy("label").agg(
                qc.F.count("*").alias("n"), qc.F.sum("w").alias("w")).collect()})
            return super().fit(dataset)

    monkeypatch.setattr(qc, "LogisticRegression", Counted)
    models = qc.fit(docs, marked, "doc_id", "text", META)
    for view in seen[-2:]:
        assert view[1.0][0] > 5_700 and view[0.0][0] > 1_900
        assert abs(view[1.0][1] - view[0.0][1]) < 1e-6 * view[1.0][1]
    kept = qc.score(docs, models, "text", META).where("kept").count()
    assert abs(kept - 6_000) < 60


def test_labels_handed_over_weigh_no_more_than_given_ones():
    own, handed = qc._weights({0.0: 10, 1.0: 30}, {0.0: 5, 1.0: 3_000})
    assert handed[0.0] == own[0.0] and abs(handed[1.0] * 3_000 - own[1.0] * 30) < 1e-9
    assert abs(own[0.0] * 15 - own[1.0] * 60) < 1e-9


def test_unlabelled_rows_are_read_by_one_python_worker_a_task(spark, data, monkeypatch):
    plans, stored = [], qc.stored

    def explained(df, name):
        plans.append((df.count(), df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name)

    monkeypatch.setattr(qc, "stored", explained)
    docs, marked = (spark.read.parquet(f"{data}/{name}.parquet") for name in ("documents", "labels"))
    assert qc.fit(docs, marked, "doc_id", "text", META) is not None
    whole = [plan for n, plan in plans if n == docs.count() and "MapInArrow" in plan]
    assert whole and not any("EvalPython" in plan for plan in whole)


def test_vectors_of_both_paths_agree(spark, monkeypatch):
    monkeypatch.setattr(qc, "SLICE_ROWS", 2)
    rows = [(1, "Fine words, fine", "en", "book", 16), (None, None, None, None, None), (3, "", "de", "web", 0),
            (4, "other words", "en", "book", 11), (5, "NO known 3", "fr", "x", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    views = {}
    for view, bits, of in (("text", qc.TEXT_BITS, lambda r: qc.text_features(r[1])),
                           ("meta", qc.META_BITS, lambda r: qc.meta_features(*r[2:]))):
        kept = sorted({int(f) for r in rows[:4] for f in of(r)})[::2]
        place, odds = qc.np.full(1 << bits, -1, qc.np.int32), qc.np.linspace(-1, 1, 1 << bits)
        place[kept] = qc.np.arange(len(kept))[::-1]
        views[view] = place, odds
    got = qc._vector_rows(docs, "doc_id", "text", META, views).collect()
    want = qc._feature_rows(docs, "doc_id", "text", META).select(
        "doc", qc._vector(*views["text"])("words").alias("text"), qc._vector(*views["meta"])("extra").alias("meta")).collect()
    key = lambda r: -1 if r.doc is None else r.doc
    assert sorted(got, key=key) == sorted(want, key=key) and any(r.text.numNonzeros() for r in got)
