import hashlib
from collections import defaultdict

import pytest

from trawl.llm import op6_mixing as mixing
from trawl.llm import op7_lines as lines

SPACE = "\t\n\x0b\x0c\r "


def size_of(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_copies(spark, odd_docs, no_docs):
    got = mixing.copies_of(odd_docs).collect()
    assert len(got) == odd_docs.count()
    again = mixing.copies_of(odd_docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes = defaultdict(int)
    for r in odd_docs.collect():
        sizes[r.source] += size_of(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, free = 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and free:  # the excess is shared again until none is above
        share = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += share * weight[s]
        full = {s for s in free if target[s] >= 2 * sizes[s]}
        left = sum(target[s] - 2 * sizes[s] for s in full)
        for s in full:
            target[s] = 2 * sizes[s]
        free -= full
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2
    assert mixing.copies_of(no_docs).collect() == []


def test_taken_words_come_near_the_target(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 977)), f"s{i % 2 if i % 3 else 9}") for i in range(3000)]
    got = mixing.copies_of(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in target)


def test_mix_repeats_rows(spark, odd_docs):
    copies = defaultdict(int)
    for r in mixing.copies_of(odd_docs).collect():
        copies[r.doc_id] += r.copies
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    found = defaultdict(int)
    for r in mixed.collect():
        found[r.doc_id] += 1
    assert found == {k: v for k, v in copies.items() if v}


def test_repeated_rows_take_their_copies_in_order(spark):
    rows = [(1, "a b c", "s", f"{i:03}") for i in range(300)] + [(None, "x", "s", str(i)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    found = [sorted(map(repr, mixing.mix(x).collect())) for x in (docs.coalesce(1), docs.coalesce(1))]
    assert found[0] == found[1] and len(found[0]) > 300
    got = mixing.copies_of(docs.repartition(5)).collect()
    assert len(got) == 350 and sum(r.copies for r in got) == len(found[0])


def dropped(rows, min_docs, min_chars=1):
    upper = str.maketrans(lines.UPPER, lines.LOWER)
    keys = [[x.strip(SPACE).translate(upper) for x in (t or "").split("\n")] for t in rows]
    count = defaultdict(int)
    for ks in keys:
        for k in set(ks):
            count[k] += 1
    out = []
    for t, ks in zip(rows, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if len(k) < min_chars or count[k] < min_docs]
        out.append((len(ks), len(ks) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("min_docs", "batches", "fanout"), [(10, 4, 2), (2, 3, 2), (2, 1, 2), (1, 5, 3)])
def test_lines_equal_brute_force(spark, odd_docs, no_docs, min_docs, batches, fanout):
    rows = odd_docs.collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, dropped([r.text for r in rows], min_docs), strict=True)), key=repr)
    result = lines.drop_lines(odd_docs, min_docs, batches=batches, fanout=fanout)
    assert result.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in result.collect()), key=repr) == want
    assert lines.drop_lines(no_docs, batches=batches).collect() == []


def test_a_line_in_every_row(spark):
    rows = [(i, "same\n" + "same\n" * (i % 4) + f"own {i}") for i in range(40)]
    got = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == {(i, f"own {i}") for i in range(40)}
    assert hashlib.sha256(b"own 0").hexdigest()
