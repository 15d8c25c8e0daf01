import zlib

import numpy as np
import pytest

from trawl.llm import op10_quality as quality


def test_repeats_count_equal_neighbours():
    raw = np.frombuffer(b"a a  a\na a a b bb bb", np.uint8)
    assert (quality.repeats(raw)[[0, 2, 5, 7, 9, 11, 13, 15, 18]] * 4).tolist() == [0, 1, 2, 3, 4, 4, 0, 0, 1]
    assert quality.repeats(np.zeros(0, np.uint8)).tolist() == []


def test_gradients_equal_differences():
    model = quality.ByteCNN()
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    model.params["h"] += 0.1  # an empty text would sit on the hidden layer's kink
    texts = [np.frombuffer(t, np.uint8) for t in (b"hello there $$ $$", b"x", b"", b"some some some words!!")]
    y, w = np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 1, 1])
    _, grads = model.gradients(texts, y, w)
    rng = np.random.default_rng(4)
    for name, value in model.params.items():
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in value.shape)
            old, losses = value[at], []
            for step in (1e-4, -1e-4):
                value[at] = old + step
                losses.append(model.gradients(texts, y, w)[0])
            value[at] = old
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, abs=2e-3), name


def test_chunks_cover_the_whole_text():
    model = quality.ByteCNN()
    text = (b"clean words here. " * 9000) + b"$$$$$$$$"
    assert (model.pooled(text) >= model.pooled(text[-900:]) - 1e-5).sum() >= quality.FILTERS - 2
    small = text[: quality.CHUNK]
    assert np.allclose(model.pooled(small), np.maximum(model.responses(np.frombuffer(small, np.uint8))[0], 0))


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op10_byte_cnn(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    labels = [x for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[x.doc_id].held_out]
    assert np.mean([rows[x.doc_id].predicted == x.quality for x in labels]) > 0.93


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (8, 0), (4, 0), (1, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train_quality(odd_docs, labels, quality.SampleSize(epochs=1))
    scored = quality.score_quality(odd_docs, model).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_quality(no_docs, model).collect() == []
    assert {r.score for r in quality.score_quality(odd_docs, None).collect()} == {0.5}
    assert quality.train_quality(no_docs, labels) is None


def plain(model, text):
    """Every filter at every place of the text, one after the other."""
    p = model.params
    raw = np.frombuffer(text, np.uint8)
    again = quality.repeats(raw)
    rows = [np.concatenate([p["E"][b], [r]]) for b, r in zip(raw, again, strict=True)]
    half, nothing = quality.WIDTH // 2, np.zeros(quality.EMBED + 1)
    rows = [nothing] * half + rows + [nothing] * half
    best = np.zeros(quality.FILTERS)
    for at in range(len(rows) - quality.WIDTH + 1 if len(raw) else 0):
        best = np.maximum(best, np.concatenate(rows[at : at + quality.WIDTH]) @ p["F"] + p["f"])
    hidden = np.maximum(best @ p["H"] + p["h"], 0)
    return 1 / (1 + np.exp(-(hidden @ p["O"] + p["o"])[0]))


def test_scores_equal_a_plain_convolution(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 400)
    monkeypatch.setattr(quality, "OVERLAP", 200)
    model = quality.ByteCNN()
    texts = [b"", b"x", b"some words !! some some some\n", b"The whole of a long text, " * 90 + b"$$$ ### and so on and on."]
    assert np.allclose(model.score(texts), [plain(model, t) for t in texts], atol=1e-5)
