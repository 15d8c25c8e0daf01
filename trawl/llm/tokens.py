"""Token ids of whole texts, by the tokenizers library with a cache of pieces.

Byte-level BPE first cuts a text into pieces (an optional space and a run of other
characters, or white space) and never merges across a cut, so the ids of a text are those of
its pieces in a row. Texts are cut by array operations on their bytes, equal pieces of a
group of texts are folded by Arrow, and the library encodes a piece once for a worker. Texts
that hold one of the tokenizer's added tokens, and all texts of a tokenizer that cuts
differently, go to the library whole: the ids are the library's own in every case.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space beyond ASCII, as the tokenizer's own pattern reads it.
WIDE_SPACES = "\x85\xa0                　"
#: Longer pieces (in bytes) are encoded each time and not kept.
_LONGEST = 64
#: Pieces that a worker keeps.
KEPT = 600_000
#: Bytes of text that are cut and folded together (a longer text alone), and pieces at a time.
GROUP, SLAB = 1 << 23, 1 << 18
#: A group with fewer pieces than one in FEW of those kept is encoded without looking them up.
FEW = 50

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WIDE = [np.frombuffer(c.encode(), np.uint8) for c in WIDE_SPACES]
_LEADS = np.zeros(256, bool)
_LEADS[[w[0] for w in _WIDE]] = True

_ENCODERS: dict[tuple[str, int], "PieceEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts (UTF-8) laid end to end, of which each begins at ``begins``.

    A run of white space is a piece; where other characters follow it, its last character is
    cut off, as a piece of its own or, if it is a space, as the beginning of theirs. A full
    stop or comma after a letter begins a piece too, which the tokenizer never joins to it.
    """
    white = _SPACE[raw]
    wide = []
    leads = np.flatnonzero(_LEADS[raw])
    for code in _WIDE if len(leads) else []:
        at = leads[leads + len(code) <= len(raw)]
        for k, byte in enumerate(code):
            at = at[raw[at + k] == byte]
        if len(at):
            wide.append((at, at + len(code) - 1))
            for k in range(len(code)):
                white[at + k] = True
    starts = np.zeros(len(raw), bool)
    starts[1:] = white[1:] & ~white[:-1]
    ends = white[:-1] & ~white[1:]  # the last byte of a run
    starts[1:] |= ends & (raw[:-1] != 32)
    inner = begins[(begins > 0) & (begins < len(raw))]
    ends[inner - 1] = False  # nothing follows in that text
    starts[:-1] |= ends
    for first, last in wide:
        own = ends[np.minimum(last, len(ends) - 1)] & (last < len(ends))
        starts[last[own]] = False
        starts[first[own]] = True
    stops = np.flatnonzero((raw == 46) | (raw == 44))
    before, lead = raw[stops - 1], raw[np.maximum(stops - 2, 0)]
    starts[stops[_LETTER[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))]] = True
    starts[begins[begins < len(raw)]] = True
    return np.flatnonzero(starts)


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    The pieces met so far and their ids are kept as Arrow arrays, about 30 bytes for a piece.
    When they come to be more than ``limit``, only those of the texts at hand are kept.
    """

    def __init__(self, path: str, limit: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(self.tokenizer.to_str())
        cuts = parts["pre_tokenizer"] or {}
        self.whole = parts["normalizer"] is not None or (cuts.get("type"), cuts.get("add_prefix_space"), cuts.get("use_regex", True)) != ("ByteLevel", False, True)
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        beyond = iter(range(256, 512))
        self.alphabet = "".join(chr(b if b in plain else next(beyond)) for b in range(256))
        self.limit = limit
        self.known, self.ids = pa.array([], pa.binary()), pa.array([], pa.list_(pa.uint32()))

    @classmethod
    def of(cls, path: str, limit: int = KEPT) -> "PieceEncoder":
        if (path, limit) not in _ENCODERS:
            _ENCODERS[path, limit] = cls(path, limit)
        return _ENCODERS[path, limit]

    def _whole(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _encoded(self, pieces: list[bytes]) -> pa.ListArray:
        """Ids of pieces. A run of letters is one word to the tokenizer, so its model is asked
        at once, in its alphabet (one character for each byte)."""
        out: list = [None] * len(pieces)
        rest, tokenize, decode, alphabet = [], self.tokenizer.model.tokenize, codecs.charmap_decode, self.alphabet
        for i, p in enumerate(pieces):
            text = p.decode("utf-8", "replace")
            if text[text[0] == " " :].isalpha():
                out[i] = [t.id for t in tokenize(decode(p, "strict", alphabet)[0])]
            else:
                rest.append(i)
        for i, ids in zip(rest, self._whole([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out)))])
        flat = np.fromiter(chain.from_iterable(out), np.uint32, int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """Rows of different pieces in a table of ids, and that table."""
        if len(pieces) * FEW < len(self.known):  # dearer to look up than to encode
            return np.arange(len(pieces)), self._encoded(pieces.to_pylist())
        row = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(row.is_null())
        made = self._encoded(new.to_pylist())
        row = np.asarray(row.fill_null(-1)).copy()
        row[row < 0] = len(self.known) + np.arange(len(new))
        table, known = pa.concat_arrays([self.ids, made]), pa.concat_arrays([self.known, new])
        own = np.arange(len(known)) if len(known) <= self.limit else row
        short = np.asarray(pc.binary_length(known))[own] <= _LONGEST
        if len(own) < len(known) or not short.all():
            keep = pa.array(own[short][: self.limit])
            self.known, self.ids = known.take(keep), table.take(keep)
        else:
            self.known, self.ids = known, table
        return row, table

    def _group(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of texts that are not empty."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = piece_starts(raw, begins[:-1])
        offsets = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        row, table = self._look_up(pieces.dictionary)
        row = row[pieces.indices.to_numpy()]
        parts, sizes = [], []
        for at in range(0, len(row), SLAB):
            taken = table.take(pa.array(row[at : at + SLAB]))
            parts.append(taken.flatten().to_numpy())
            sizes.append(np.diff(taken.offsets.to_numpy()))
        ids = np.concatenate(parts)
        first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])  # of each piece
        cuts = first[np.append(np.searchsorted(starts, begins[:-1]), len(starts))].tolist()
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield ids[b:e].tobytes()

    def encode_all(self, texts: list[bytes | None], at_once: int = GROUP) -> Iterator[bytes]:
        """The ids of each text (UTF-8) in turn; about ``at_once`` bytes are looked at together."""
        i = 0
        while i < len(texts):
            size, first = 0, i
            while i < len(texts) and (i == first or size < at_once):
                size += len(texts[i] or b"")
                i += 1
            part = [t or b"" for t in texts[first:i]]
            alone = {k for k, t in enumerate(part) if self.whole or any(a in t for a in self.added)}
            whole = iter(self._whole([part[k] for k in sorted(alone)]))
            cut = self._group(own) if (own := [t for k, t in enumerate(part) if t and k not in alone]) else iter(())
            for k, t in enumerate(part):
                yield np.array(next(whole), "<u4").tobytes() if k in alone else next(cut) if t else b""

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([None if text is None else text.encode()]))
