import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import op1_ans as ans
from trawl.llm.common import scratch
from trawl.llm.tokens import PieceEncoder, default_path


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def whole(text):
    return library().encode(text, add_special_tokens=False).ids


BITS = [" ", "  ", "\n", "\t", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000", "a", "sol", "b1", "\xe9", "\xd7", "\xdf", ".", ",", "'s", "'ll", "'", "$", "\u65e5", "\u0301", "\0", "<|endoftext|>", "<|endof"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(BITS), max_size=10).map("".join), st.text(st.characters(exclude_categories=["Cs"]), max_size=20)), max_size=6))
def test_ids_equal_the_library(texts):
    found = PieceEncoder.of(default_path()).encode_all([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [whole(t) for t in texts]


def test_small_cache_gives_the_same_ids():
    text = " ".join(f"w{i}x{i * i}" for i in range(200)) + " " + "z" * 100
    tight = PieceEncoder(default_path(), limit=20)
    assert tight.encode(text) == tight.encode(text) == PieceEncoder(default_path()).encode(text)
    assert len(tight.known) == len(tight.ids) <= 20


def test_another_tokenizer_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some  Words, and 12 more."
    assert np.frombuffer(PieceEncoder(path).encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 255, 257, 70_000, 300_001])
def test_frame_round_trip_and_checkpoints(n):
    ids = np.random.default_rng(n).zipf(1.3, n).astype(np.int64) % 50257
    docs = [ids[: n // 3].astype("<u4").tobytes(), b"", ids[n // 3 :].astype("<u4").tobytes()]
    data = ans.encode_frame([5, None, -7], docs)
    frame = ans.Frame(data)
    assert frame.doc_ids == [5, None, -7] and frame.lengths.tolist() == [n // 3, 0, n - n // 3]
    assert frame.decode().tolist() == ids.tolist()
    parts = [frame.decode_from(b, m) for b in range(frame.blocks) for m in range(-(-frame.steps // frame.interval))]
    assert np.concatenate(parts).tolist() == ids.tolist()
    if n > 60_000:
        assert len(data) < 2 * n + 60_000


def test_damage_is_noticed():
    data = bytearray(ans.encode_frame([1], [np.arange(1000, dtype="<u4").tobytes()]))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ans.Frame(bytes(data))


def test_digests(spark, odd_docs, no_docs):
    path = scratch(spark, "ids")
    ans.write_ids(odd_docs, path, frame=5000)
    got = sorted(map(tuple, ans.read_digests(spark, path).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))  # ids repeat with equal texts only
    start, want = 0, []
    for doc_id, text in rows:
        ids = whole(text) + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    ans.write_ids(no_docs, path + "-none")
    assert ans.read_digests(spark, path + "-none").collect() == []
