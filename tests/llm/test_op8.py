import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import op8_packing as packing
from trawl.llm.tokens import default_path


def check(rows, capacity):
    by = {}
    for length, sequence, offset in rows:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def laid_out(counts, capacity):
    out, seen = [], Counter()
    for length, rank, pieces, sequence, each, offset in packing.plan_packing(dict(counts), capacity):
        assert rank == seen[length]
        seen[length] += pieces
        out += [(length, sequence + i // each, offset + i % each * length) for i in range(pieces)]
    assert seen == counts
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plans_are_whole_and_gapless(counts):
    rows = laid_out(Counter(counts), 40)
    n = check(rows, 40)
    halves = sum(c for k, c in counts.items() if k > 20)
    assert n <= max(halves, 1.5 * -(-sum(k * c for k, c in counts.items()) // 40)) + halves // 2 + 1


def test_plan_is_near_the_bound_and_small():
    rng = random.Random(1)
    counts = Counter(min(2048, int(rng.lognormvariate(6.3, 1.1)) + 1) for _ in range(200_000))
    n = check(laid_out(counts, 2048), 2048)
    assert n <= 1.01 * sum(k * c for k, c in counts.items()) / 2048
    assert len(packing.plan_packing({k: c * 10**6 for k, c in counts.items()})) < 60_000


@pytest.mark.parametrize("capacity", [64, 2048])
def test_documents(spark, odd_docs, no_docs, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    got = packing.pack_documents(odd_docs, capacity).collect()
    check([(r.length, r.sequence_id, r.offset) for r in got], capacity)
    want = []
    for row in odd_docs.collect():
        ids = t.encode(row.text or "", add_special_tokens=False).ids + [0]
        cut = (len(ids) - 1) % capacity + 1
        for k, (b, e) in enumerate([(0, cut)] + [(b, b + capacity) for b in range(cut, len(ids), capacity)]):
            want.append((row.doc_id, k, b, e - b, zlib.crc32(np.array(ids[b:e], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert packing.pack_documents(no_docs, capacity).collect() == []


def fewest(lengths, capacity):
    """The fewest sequences, by trying every place for each piece."""
    best = len(lengths)

    def place(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for gap in set(gaps):
            if gap >= lengths[i]:
                rest = list(gaps)
                rest[rest.index(gap)] -= lengths[i]
                place(i + 1, rest)
        place(i + 1, [*gaps, capacity - lengths[i]])

    place(0, [])
    return best


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps[gaps.index(min(fitting))] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plans_are_near_the_fewest():
    rng = random.Random(4)
    over = 0
    for _ in range(150):
        lengths = [rng.randrange(1, 31) for _ in range(rng.randrange(1, 8))]
        n = check(laid_out(Counter(lengths), 30), 30)
        over += n - fewest(sorted(lengths, reverse=True), 30)
        assert n <= best_fit(lengths, 30) + 1
    assert over <= 3
    lengths = [min(2048, int(rng.lognormvariate(6.3, 1.1)) + 1) for _ in range(3000)]
    assert check(laid_out(Counter(lengths), 2048), 2048) <= 1.01 * best_fit(lengths, 2048)
