import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import op12_phrases as op

_LOW = str.maketrans(op.UPPER, op.LOWER)


def plain(docs, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    rows = {}
    inner = Counter()
    for p, a in f.items():
        if a >= least and len(p) > 2:
            lang, *w = p
            cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows[p] = (lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score)
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    q = (lang, *w[i : i + m])
                    inner[q] = max(inner[q], a)
    kept = [r for p, r in rows.items() if not inner[p] >= r[2]]
    out = []
    for lang in {r[0] for r in kept}:
        own = sorted((r for r in kept if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, k + 1, *r[1:]) for k, r in enumerate(own)]
    return sorted(out)


def some_docs(rng, n):
    words = ["the", "Of", "sol", "mar", "É9", "\x1c", "ant"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(1, 60)))
    return [(rng.choice(["en", "de", None]), text()) for _ in range(n)] + [("en", None), ("xx", ""), (None, " .,"), ("en", "the sol mar ant of " * 50)]


@pytest.mark.parametrize("least,options", [(3, {}), (1, {}), (5, {"vocabulary": 3, "most": 4}), (4, {"max_words": 3}), (10**6, {})])
def test_equals_plain_counts(spark, least, options):
    docs = some_docs(random.Random(least), 60)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    rows = op.collocations(df, min_count=least, **options).collect()
    assert sorted(map(tuple, rows)) == plain(docs, least, options.get("max_words", 5))


def test_top_cuts_by_rank(spark):
    docs = some_docs(random.Random(1), 40)
    rows = op.collocations(spark.createDataFrame(docs, "lang string, text string"), top=4, min_count=3).collect()
    assert sorted(map(tuple, rows)) == plain(docs, 3, top=4)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(*[st.integers(1, 7)] * 3), min_size=1, max_size=120), st.lists(st.integers(0, 7), max_size=60), st.integers(7, 5000))
def test_trie_accepts_exactly_its_phrases(phrases, ids, largest):
    phrases = np.array(sorted(phrases, key=hash), np.int32)
    trie = op.Trie(phrases, largest)
    at, which = trie.accepted(np.array(ids, np.int32))
    rows = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    want = {i: rows[tuple(ids[i : i + 3])] for i in range(len(ids) - 2) if tuple(ids[i : i + 3]) in rows}
    assert dict(zip(at.tolist(), which.tolist())) == want


def test_large_trie_has_every_phrase_once():
    rng = np.random.default_rng(5)
    phrases = np.unique(np.minimum(rng.zipf(1.3, (60_000, 3)), 3000), axis=0).astype(np.int32)
    trie = op.Trie(phrases, 3000)
    flat = np.concatenate([phrases, np.zeros((len(phrases), 1), np.int32)], axis=1).ravel()
    at, which = trie.accepted(flat)
    whole = at % 4 == 0
    assert (which[whole] == np.arange(len(phrases))).all()
    assert len(trie.base) < 8 * len(phrases) + 6000


def test_words_take_further_passes_alike(spark):
    docs = spark.createDataFrame(some_docs(random.Random(3), 30), "lang string, text string")
    counts = op.word_counts(docs.fillna("und", ["lang"]).fillna("", ["text"]))
    words = op.dense(counts.select("lang", "word"), "vocabulary")
    rows = lambda most: sorted(bytes(r.ids) for r in op.encoded(docs.fillna("und", ["lang"]).fillna("", ["text"]), words, most).collect())
    assert rows(2) == rows(1000) and all(len(r) % 4 == 0 and r[-4:] in (b"", bytes(4)) for r in rows(1000))


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, op.collocations(odd_docs, min_count=8).collect())) == plain(docs, 8)
    assert op.collocations(no_docs).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = op.op12_collocations(spark, sf)
    found = duckdb.sql(op.ORACLE)
    assert found.columns == got.columns and [t for _, t in got.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    want = found.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 5
