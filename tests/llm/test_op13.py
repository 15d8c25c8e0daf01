import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import op13_resampling as op

SF = "/root/testdata/sf0.001"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target, percent=25, least=20, buckets=10_000):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    own = [plain_features(t) for _, t in docs]
    s = Counter(bucket(x) for _, f in own for x in f)
    t = Counter(bucket(x) for text in target for x in plain_features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for (i, _), (w, f) in zip(docs, own):
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def compare(rows, want):
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_equals_plain_counts_and_sql(spark):
    import duckdb

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = op.op13_resampling(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    rows = got.collect()
    compare(rows, plain(docs, target))
    assert sum(r["rank"] is not None for r in rows) > 10
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = duckdb.sql(op.ORACLE)
    assert found.columns == got.columns
    compare(rows, found.fetchall())


def test_lines_are_counted_once_and_multiplied(spark):
    rng = random.Random(2)
    lines = ["", " ", "One two", "one TWO three", "É x9,y", "lone", "--"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    kept = op.distinct_lines(docs)
    assert kept.count() == len(lines)
    want = np.bincount([zlib.crc32(x.encode()) % 97 for t in texts for x in plain_features(t)[1]], minlength=97)
    assert (op.bucket_counts(docs, kept, 97) == want).all()


def test_line_counts_alone_would_miss_pairs(spark):
    docs = spark.createDataFrame([(1, "a\n\n b\nc d")], "doc_id long, text string")
    kept = op.distinct_lines(docs)
    within = kept.select("line", "copies").mapInArrow(op._counts(False, 10_000), "bucket long, n long").groupBy().sum("n").first()[0]
    assert within == 5 and op.bucket_counts(docs, kept).sum() == 7


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("aB9 \n\té.", max_size=20), max_size=6), st.booleans())
def test_features_are_those_of_plain_python(texts, crossing):
    of, bucket = op.features(pa.array(texts, pa.string()), crossing, 10_007)
    want = Counter()
    for i, t in enumerate(texts):
        all_ = Counter(plain_features(t)[1])
        if crossing:
            for line in t.split("\n"):
                all_.subtract(plain_features(line)[1])
        for x, n in all_.items():
            want[i, zlib.crc32(x.encode()) % 10_007] += n
    assert Counter(zip(of.tolist(), bucket.tolist())) == +want


def test_long_words(spark):
    for sizes in ((1, 64), (64, 65), (65, 1), (300, 200), (5, 63)):
        text = " ".join("ab"[i % 2] * n for i, n in enumerate(sizes))
        _, bucket = op.features(pa.array([text]), False, 1 << 31)
        assert sorted(bucket.tolist()) == sorted(zlib.crc32(x.encode()) % (1 << 31) for x in plain_features(text)[1])


@pytest.mark.parametrize("target", [[], ["the ant 1"], [None, "sol\nmar"]])
def test_odd_rows(spark, odd_docs, no_docs, target):
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = op.resample(odd_docs, wanted).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    compare(got, plain(rows, target))
    assert op.resample(no_docs, wanted).count() == 0


def test_ties_go_to_smaller_ids(spark):
    docs = spark.createDataFrame([(i // 2, " ".join(["w"] * 30)) for i in range(40)], "doc_id long, text string").repartition(7)
    rows = op.resample(docs, docs.limit(0), percent=100).collect()
    compare(rows, plain([(i // 2, " ".join(["w"] * 30)) for i in range(40)], [], percent=100))
    assert sorted(r["rank"] for r in rows) == list(range(1, 41))
