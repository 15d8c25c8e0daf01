"""The pipeline's stages, one by one and together, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_op3 import slow_fingerprint
from tests.llm.test_op6_op7 import dropped
from trawl.llm import jaccard
from trawl.llm.op2_language import SampleSize, keep_recognised
from trawl.llm.tokens import default_path

SF = "/root/testdata/sf0.001"


def key(r):
    return (r.doc_id is not None, r.doc_id or 0, r.text or "")


def mixed(rows):
    """Copies of each row, by one walk along each source."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for r in rows:
        total[r.source] += size(r.text)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(total.values())
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += share * weight[s]
        full = {s for s in free if target[s] >= 2 * total[s]}
        left = sum(target[s] - 2 * total[s] for s in full)
        target |= {s: 2.0 * total[s] for s in full}
        free -= full
    out = []
    for s in order:
        u = int(hashlib.md5(("0/" + ("n" if s is None else "s" + s)).encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / total[s] if total[s] else 0.0

        def place(r):
            b = bin(size(r.text) + 8)[2:]
            salt = hashlib.md5(("0" if r.doc_id is None else f"0:{r.doc_id}").encode()).hexdigest()[:2]
            return len(b) * 8 + int(b[1:4], 2), int(salt, 16), size(r.text), r.doc_id is not None, r.doc_id or 0

        for i, r in enumerate(sorted((r for r in rows if r.source == s), key=place)):
            out += [r] * int(np.floor((i + 1) * rate + u) - np.floor(i * rate + u))
    return out


def stages(spark, docs):
    """Each stage's rows as Spark gives them, reread as the next one's input."""
    out = []
    for _, stage in pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") if rows and "text" in rows[0] else docs
    return out


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.collect(), stages(spark, docs)


def test_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixing", "packing"]


def test_language_keeps_clean_documents(results):
    docs, out = results
    kept = {r.doc_id for r in out[0]}
    assert all((r.doc_id in kept) == bool(r.text and any(c.isalpha() for c in r.text)) for r in docs)


def test_lines(results):
    _, out = results
    want = [(r.doc_id, t) for r, (_, _, t) in zip(out[0], dropped([r.text for r in out[0]], 10), strict=True)]
    assert sorted((r.doc_id, r.text) for r in out[1]) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in out[1])


def linked(texts):
    """Each text's smallest mate, over links by fingerprint and by shingle sets."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    fps = np.array([slow_fingerprint(t, pipeline.SHINGLE) for t in texts], np.uint64)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        near = set((np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= pipeline.RADIUS) + i + 1).tolist())
        near |= {j for j in range(i + 1, len(texts)) if sets[i] and len(sets[j]) * 5 >= 4 * len(sets[i]) and len(sets[i]) * 5 >= 4 * len(sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        for j in near:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(results):
    _, out = results
    rows = sorted(out[1], key=lambda r: r.doc_id)
    first = {rows[i].doc_id for i in linked([r.text for r in rows])}
    assert sorted(r.doc_id for r in out[2]) == sorted(first)


def test_mixing(results):
    _, out = results
    assert Counter(map(tuple, out[3])) == Counter(map(tuple, mixed(out[2])))


def test_packing(results):
    from tokenizers import Tokenizer

    _, out = results
    t = Tokenizer.from_file(default_path())
    want = Counter()
    for r in out[3]:
        ids = t.encode(r.text, add_special_tokens=False).ids + [0]
        cut = (len(ids) - 1) % 2048 + 1
        for b, e in [(0, cut)] + [(b, b + 2048) for b in range(cut, len(ids), 2048)]:
            want[r.doc_id, b, e - b, zlib.crc32(np.array(ids[b:e], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in out[4]) == want
    filled = defaultdict(list)
    for r in out[4]:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_run_is_its_stages(spark, results):
    got = Counter(tuple(r) for r in pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert got == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in results[1][4])


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.select(pipeline.COLUMNS)
    small = SampleSize(documents=40, windows=4, steps=60, batch=64)
    docs = keep_recognised(docs, least=0.0, size=small)
    assert {r.doc_id for r in docs.collect()} >= {4, 7, None}
    for _, stage in pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
        assert docs.columns == pipeline.COLUMNS or "sequence_id" in docs.columns
    assert docs.count() > 0


def test_empty_table(spark, no_docs):
    docs = no_docs.select(pipeline.COLUMNS)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_duplicates_by_shingles(spark, monkeypatch):
    """Every pair of a five-word Jaccard similarity of 0.8 is linked, however far its fingerprints are."""
    import random

    from trawl.llm import jaccard

    rng, texts = random.Random(8), []
    for _ in range(30):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 200]))]
        texts.append(base)
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 30 + 1)):
                copy[rng.randrange(len(copy))] = "x" if rng.randrange(2) else f"w{rng.randrange(400)}"
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", "A b", "a  B", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    root = linked(texts)
    fps = [slow_fingerprint(t, pipeline.SHINGLE) for t in texts]
    assert any((fps[i] ^ fps[r]).bit_count() > pipeline.RADIUS for i, r in enumerate(root))
    want = sorted(set(root))
    # all pairs at once; common shingles last, and rounds of leaders; groups in many small blocks
    for sample, dense, block in ((64, 8, 256), (1, 0, 256), (64, 1000, 2)):
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "DENSE", dense)
        assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).collect()) == want


def test_parities_never_part_similar_sets():
    from trawl.llm import jaccard

    rng = np.random.default_rng(3)
    for n in (1, 40, 500, 513, 3000, 20_000):
        for cut in (0, n // 9, n // 5):
            x = np.unique(rng.integers(-(2**62), 2**62, n))
            y = np.unique(np.concatenate([x[cut:], rng.integers(-(2**62), 2**62, n // 12)]))
            apart = len(np.setxor1d(x, y))
            assert jaccard.differing([jaccard.parities(x)], [jaccard.parities(y)])[0] <= apart
            if jaccard.similar(x, y):
                assert 9 * apart <= len(x) + len(y)
        other = np.unique(rng.integers(-(2**62), 2**62, n))
        if n >= 500:  # sets without a shingle in common are told apart at any size
            assert 9 * jaccard.differing([jaccard.parities(x)], [jaccard.parities(other)])[0] > len(x) + len(other)


def test_prefixes_of_similar_sets_share_enough(spark):
    rng = np.random.default_rng(8)
    order, rows = jaccard.Order(np.empty(0, np.int64)), []
    for _ in range(400):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 10**6, n))
        gone, new = rng.integers(0, 1 + len(x) // 8), rng.integers(0, 1 + len(x) // 8)
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(10**6, 2 * 10**6, new)]))
        if len(y) and jaccard.similar(x, y):
            p, q = order.prefixes([x, y])
            rows.append((len(x), len(y), len(np.intersect1d(p, q))))
    df = spark.createDataFrame(rows, "n long, m long, shared long")
    assert len(rows) > 200 and df.filter(~jaccard._enough(df.n, df.m, df.shared)).count() == 0


def test_each_pair_of_a_group_meets_once(spark, monkeypatch):
    """Pairs of blocks, over batches that cut them: all pairs of equal parities and unlike roots."""
    rows = [(token, tk, tk % 7, 100, tk % 5) for token, k in ((1, 2), (2, 37), (3, 150)) for tk in range(k)]
    members = spark.createDataFrame(rows, "token long, tk long, fp long, n long, root long")
    own = spark.range(150).selectExpr("id AS tk", f"cast(repeat('a', {jaccard.BITMAP // 8}) AS binary) AS least")
    sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    want = sorted((x, y) for k in (2, 37, 150) for y in range(k) for x in range(y) if x % 5 != y % 5)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    for size in ("7", "10000"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = jaccard.close_pairs(members, sizes, own).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert sorted((r.tk, r.tk2) for r in found) == want
        assert all(r.fp == r.tk % 7 and r.fp2 == r.tk2 % 7 and r.n == r.n2 == 100 for r in found)
