import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import op2_language as lang

SMALL = lang.SampleSize(documents=60, windows=4, steps=120, batch=96)


def test_gradients_equal_differences():
    model = lang.BiGRU.fresh(["a", "b", "c"], hidden=3)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    rng = np.random.default_rng(0)
    x = rng.integers(0, lang.PAD + 1, (7, 4)).astype(np.uint16)
    y = np.array([0, 1, 2, 1])
    _, grads = model.gradients(x, y)
    for name, value in model.params.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in value.shape)
            if name[0] == "W":
                at = (at[0], int(x[rng.integers(7), rng.integers(4)]))
            old, eps = value[at], 1e-3
            losses = []
            for step in (eps, -eps):
                value[at] = old + step
                losses.append(model.gradients(x, y)[0])
            value[at] = old
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / (2 * eps), abs=2e-4), name


def test_scoring_does_not_depend_on_the_batch():
    model = lang.BiGRU.fresh(["a", "b"])
    texts = [b"x", b"The quick " * 100, "ñandú é".encode(), b"y" * 64, b"z" * 65]
    best, score = lang.predict(model, texts)
    for t, b, s in zip(texts, best, score, strict=True):
        one = lang.predict(model, [t])
        assert one[0][0] == b and one[1][0] == pytest.approx(s, abs=1e-6)


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in lang.op2_language(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == docs.count()
    right = []
    for d in docs.select("doc_id", "text", "lang").collect():
        r = rows[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out and d.lang and d.text:
            right.append(r.lang_pred == d.lang)
    assert np.mean(right) > 0.95
    kept = lang.keep_recognised(docs)
    assert kept.columns == docs.columns
    assert kept.count() > 0.98 * docs.filter("text rlike '\\\\p{L}'").count()


def test_odd_rows(spark, odd_docs, no_docs):
    model = lang.train_languages(odd_docs, SMALL)
    assert sorted(model.languages) == ["de", "en", "fr"]
    found = lang.score_languages(odd_docs, model)
    assert found.select("row.*").columns == odd_docs.columns
    rows = found.select("row.text", "lang_pred", "score").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has) and (has or r.score == 0)
    assert lang.train_languages(no_docs, SMALL) is None
    assert lang.score_languages(no_docs, model).collect() == []
    assert {r.lang_pred for r in lang.score_languages(odd_docs, None).collect()} == {"und"}


def test_a_repeated_id_is_sampled_once(spark, monkeypatch):
    from trawl.llm import op2_language as op2

    sizes = []
    monkeypatch.setattr(op2.BiGRU, "train", lambda self, x, *a: sizes.append(len(x)))
    docs = spark.createDataFrame([(1, f"words of text {i}", "en") for i in range(50)] + [(2, "other words", "en")], "doc_id long, text string, lang string")
    op2.train_languages(docs, op2.SampleSize(documents=40, windows=4, steps=1, batch=2))
    assert sizes and sizes[0] <= 2 * 4


def plain(model, text):
    """One position after the other, both ways through a window, as the definition says."""
    p = {k: v.astype(np.float64) for k, v in model.params.items()}
    h, total = p["Uf"].shape[1], np.zeros(len(model.languages))
    for at in range(0, len(text), lang.WINDOW):
        part = text[at : at + lang.WINDOW] + bytes(0)
        codes = list(part) + [lang.PAD] * (lang.WINDOW - len(part))
        states = {}
        for d in "fb":
            s, out = np.zeros(h), [None] * len(codes)
            for t in range(len(codes)) if d == "f" else reversed(range(len(codes))):
                gx, gh = p[f"W{d}"][:, codes[t]] + p[f"b{d}"][:, 0], p[f"U{d}"] @ s
                z, r = (np.clip((gx[k * h : k * h + h] + gh[k * h : k * h + h]) / 4 + 0.5, 0, 1) for k in (0, 1))
                n = np.tanh(gx[2 * h :] + r * gh[2 * h :])
                s = out[t] = z * s + (1 - z) * n
            states[d] = out
        for t in range(len(part)):
            q = np.exp(p["V"] @ np.concatenate([states["f"][t], states["b"][t]]) + p["c"][:, 0])
            total += q / q.sum()
    return total / len(text)


def test_scores_equal_a_plain_network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang.train_languages(docs, lang.SampleSize(documents=20, windows=4, steps=30, batch=64))
    rows = lang.score_languages(docs, model).selectExpr("row.doc_id", "row.text", "lang_pred", "score").filter("lang_pred <> 'und'").orderBy(F.length("text"), "doc_id").collect()
    for r in [*rows[:10], *rows[90:95]]:
        want = plain(model, r.text.encode())
        assert want.max() == pytest.approx(r.score, abs=1e-4) and want[model.languages.index(r.lang_pred)] == pytest.approx(want.max(), abs=1e-4)


def test_samples_are_bounded_and_do_not_hang_on_partitions(spark):
    from trawl.llm.common import sample_ids

    rows = spark.range(6000).selectExpr("id % 5000 AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 50 = 1 THEN 'b' WHEN id % 50 = 2 THEN NULL ELSE 'c' END AS lang")
    got = sorted(map(tuple, sample_ids(rows, "lang", 100).collect()))
    assert got == sorted(map(tuple, sample_ids(rows.repartition(7), "lang", 100).collect()))
    sizes = {x: sum(1 for _, y in got if y == x) for x in "abc"}
    assert all(50 < n < 150 for n in sizes.values()) and len(got) == len(set(got)) == sum(sizes.values())


def test_sample_knows_no_most_frequent_labels(spark):
    from trawl.llm.common import sample_ids

    rows = spark.range(0, 4000).selectExpr("id AS doc_id", "concat('l', id % 400) AS lang")
    assert sample_ids(rows, "lang", 8).select("lang").distinct().count() > 390
    few = sample_ids(rows, "lang", 8, in_all=800).collect()
    assert len({r.lang for r in few}) > 300 and len(few) < 1200
