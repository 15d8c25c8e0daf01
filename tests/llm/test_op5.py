import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import op5_rules as rules


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab \n\t\x1c#é<", max_size=120)))
def test_counts_equal_brute_force(text):
    assert rules.measure(None if text is None else text.encode())[0] == slow(text)


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) < 0.5) ^ (rng.random(1500) < 0.1)).astype(float)
    trees = rules.grow(x, y, [-1, 0, 0])
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.85
    line = np.repeat(rng.random((20, 1, 3)), 200, axis=1)
    line[:, :, 0] = np.linspace(-0.5, 1.5, 200)
    scores = trees.score(line.reshape(-1, 3)).reshape(20, 200)
    assert (np.diff(scores, axis=1) <= 1e-12).all() and scores[:, 0].min() > scores[:, -1].max()
    free = rules.grow(x, y, [0, 0, 0])
    assert (np.diff(free.score(line.reshape(-1, 3)).reshape(20, 200), axis=1) > 0).any()


def walked(trees, x):
    """One tree after the other, node by node."""
    total = trees.base
    for at in trees.roots:
        while trees.left[at] != at:
            at = trees.left[at] if x[trees.feature[at]] <= trees.cut[at] else trees.right[at]
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def test_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in rules.op5_tree_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    trees = rules.train_rules(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    for d in docs.filter("doc_id < 2000").collect():
        r = got[d.doc_id]
        assert [r[c] for c in rules.COUNTS] == slow(d.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
        assert r.kept == (not r.base_failed and walked(trees, rules.measure((d.text or "").encode())[1]) >= 0.5)
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[x.doc_id].kept for x in labels if x.quality == 1 and not got[x.doc_id].base_failed]
    bad = [got[x.doc_id].kept for x in labels if x.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (8, 0), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    trees = rules.train_rules(odd_docs, labels)
    judged = rules.judge(odd_docs, trees)
    assert judged.select("row.*").columns == odd_docs.columns
    for r in judged.select("row.text", *rules.COUNTS).collect():
        assert [r[c] for c in rules.COUNTS] == slow(r.text)
    assert rules.judge(no_docs, trees).collect() == []
    assert rules.train_rules(no_docs, labels) is None
    assert rules.keep_good(odd_docs, labels.filter("quality = 1")).columns == odd_docs.columns
