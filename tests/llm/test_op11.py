import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawl.llm import op11_repeats as op
from trawl.llm.spans import SPACE, gathered, owners, run_hashes, sizes_of, spans, word_hashes


def plain(texts, window):
    """Kept words of each text, by a dictionary of all windows."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def random_texts(rng, n, vocabulary, longest):
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 30))] for _ in range(6)]
    out = []
    for _ in range(n):
        words = []
        while len(words) < rng.randrange(longest):
            words += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))]
        out.append(rng.choice([" ", "  ", "\n", "\t "]).join(words))
    return out


@pytest.mark.parametrize("window,group_bytes,letters", [(5, 1 << 20, 40), (5, 300, 40), (12, 2000, 3), (1, 1 << 20, 9), (35, 1 << 20, 2)])
def test_equals_dictionary_of_windows(spark, window, group_bytes, letters):
    rng = random.Random(window * letters)
    texts = random_texts(rng, 60, [f"w{i}é" for i in range(letters)], 90)
    texts += [texts[3], texts[3], "", None, " \n", "one", "same " * 80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = op.remove_repeats(docs, window, group_bytes).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.text) for r in rows] == plain(texts, window)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_tree_nodes_are_equal_prefixes(words, depth):
    words = np.array(words, np.int64)
    starts = np.arange(max(0, len(words) - depth + 1))
    nodes = op.deep_nodes(words, starts, depth)
    cut = [tuple(words[i : i + depth]) for i in starts]
    many = Counter(cut)
    assert [x >= 0 for x in nodes] == [many[c] > 1 for c in cut]
    assert len({(n, c) for n, c in zip(nodes, cut) if n >= 0}) == len({n for n in nodes if n >= 0}) == sum(v > 1 for v in many.values())


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    owner = np.repeat([0, 1, 1, 2], 750)
    for window in (1, 8, 9, 20):
        g, s, n = op.anchor_runs(words, owner, window)
        of = {}
        for h, a, m in zip(g.tolist(), s.tolist(), n.tolist()):
            for i in range(a, a + m):
                assert owner[i] == owner[i + window - 1] and i not in of
                of[i] = h
        assert len(of) == sum(owner[i] == owner[i + window - 1] for i in range(len(words) - window + 1))
        by = {}
        for i, h in of.items():
            assert by.setdefault(tuple(words[i : i + window]), h) == h


def test_anchors_do_not_depend_on_segments(monkeypatch):
    words = np.random.default_rng(4).integers(0, 9, 500).astype(np.uint64)
    flat = lambda: {(h, i) for h, a, m in zip(*(x.tolist() for x in op.anchor_runs(words, np.zeros(500, int), 10))) for i in range(a, a + m)}
    want = flat()
    monkeypatch.setattr(op, "SEGMENT", 7)
    assert flat() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\té\x1c", max_size=12), max_size=6))
def test_spans_are_words(texts):
    import pyarrow as pa

    raw, begins = sizes_of(pa.array(texts, pa.string()))
    starts, ends = spans(raw, begins, SPACE)
    want = [(i, w) for i, t in enumerate(texts) for w in t.encode().split()]
    assert list(zip(owners(begins, starts).tolist(), gathered(raw, starts, ends).to_pylist())) == want
    hashes = word_hashes(raw, starts, ends)
    assert len(set(hashes.tolist())) == len({w for _, w in want}) == len({(w, h) for (_, w), h in zip(want, hashes.tolist())})
    assert len(run_hashes(hashes, 3)) == max(0, len(want) - 2)


def test_long_words_hash_alike_wherever_they_stand():
    import pyarrow as pa

    long = "x" * 5000
    raw, begins = sizes_of(pa.array([f"a {long} b", "c " * 600_000 + long + " b a"]))
    starts, ends = spans(raw, begins, SPACE)
    h = word_hashes(raw, starts, ends)
    assert h[0] == h[-1] and h[1] == h[-3] and h[2] == h[-2] and len(set(h.tolist())) == 4


def test_odd_rows(odd_docs, no_docs):
    rows = op.remove_repeats(odd_docs).collect()
    texts = [r.text for r in odd_docs.collect()]
    assert sorted((r.n_words, r.n_removed, r.text) for r in rows) == sorted(plain(texts, op.WINDOW))
    assert set(odd_docs.columns) | {"n_words", "n_removed"} == set(op.remove_repeats(odd_docs).columns)
    assert all(r._id == (None if r.doc_id is None else f"_id{r.doc_id}") or hasattr(r._id, "x") for r in rows)
    assert op.remove_repeats(no_docs).count() == 0


def test_query_takes_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    rows = op.op11_suffix_repeats(spark, sf).orderBy("doc_id").collect()
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, m, t) in zip(texts, plain([t for _, t in texts], op.WINDOW), strict=True)]
    assert [tuple(r) for r in rows] == want
    assert sum(r.n_removed for r in rows) > 0


def test_planted_passage_goes_and_clean_text_stays(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage = fresh(60)
    docs = spark.createDataFrame([(i, f"{fresh(20)} {passage} {fresh(20)}" if i % 3 else fresh(100)) for i in range(90)], "doc_id long, text string")
    for r in op.remove_repeats(docs, group_bytes=4000).withColumn("has", F.contains("text", F.lit(passage[:40]))).collect():
        assert r.n_removed == (60 if r.doc_id % 3 else 0) and not r.has
