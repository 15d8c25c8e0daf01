"""Token-ID output in a binary format: static range asymmetric numeral system.

Documents are range-partitioned by doc_id, encoded by a tokenizer and written as frames. A
frame is one binary value of up to ``FRAME`` ids of whole documents: a header, the documents'
ids and lengths, one frequency table shared by the frame's blocks, and the blocks. A block is
a run of ids dealt over ``LANES`` interleaved rANS states; lane ``j`` of step ``t`` holds id
``t * LANES + j``. Each block has its own words, a CRC-32 of its ids and, every
``CHECKPOINT`` steps, the states and the word position from which decoding can begin. Frames
are values of a Parquet folder written and read by Spark, so a lost executor costs its tasks
only, and the frames of a folder are decoded independently of each other.

Defined cases: null text counts as empty (only the end id); a null doc_id sorts first; rows
with equal doc_id are all kept, in order of a hash of their texts, then of the texts; equal
rows keep any order, which their ids do not show; an empty table gives no frames and no rows;
a text of more than ``FRAME`` ids has a frame of its own; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import scratch, slices, small_batches, table, utf8
from trawl.llm.tokens import PieceEncoder, default_path

MAGIC = b"RNS1"
BITS = 20  # a table's frequencies sum to 2**BITS
LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
FRAME = 1 << 21
BLOCK = 1 << 17
LANES = 256
CHECKPOINT = 256
END_ID = 2
_HEADER = struct.Struct("<4sIQIIII")  # magic, documents, ids, blocks, lanes, steps, checkpoint interval
FRAMES = "shard long, frame long, first long, n_tokens long, data binary"
DECODED = "shard long, doc_id long, start long, n_tokens long, ids_crc32 long"


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur, ascending, and frequencies of at least 1 that sum to 2**BITS."""
    symbols, counts = np.unique(ids, return_counts=True)
    spare = (1 << BITS) - len(symbols)
    if spare < 0:
        raise ValueError(f"more than {1 << BITS} different ids in a frame")
    exact = counts * (spare / max(1, counts.sum()))
    freq = 1 + exact.astype(np.int64)
    freq[np.argmax(counts)] += (1 << BITS) - int(freq.sum())
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def encode_blocks(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray, block: int = BLOCK, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> tuple[int, int, list[bytes]]:
    """Blocks, steps of a block, and each block as bytes; all blocks advance together."""
    n = len(ids)
    blocks = max(1, -(-n // block))
    steps = max(1, -(-n // (blocks * lanes)))
    index = np.zeros(blocks * steps * lanes, np.int64)  # padded with the first symbol
    index[:n] = np.searchsorted(symbols, ids)
    grid = index.reshape(blocks, steps, lanes)
    f_all = freq.astype(np.uint64)
    c_all = np.concatenate([[0], np.cumsum(freq[:-1], dtype=np.uint64)]).astype(np.uint64)
    x = np.full((blocks, lanes), LOW, np.uint64)
    put = np.zeros((steps, blocks, lanes), bool)
    words = np.zeros((steps, blocks, lanes), np.uint32)
    marks: dict[int, np.ndarray] = {}
    top = np.uint64(63 - BITS)
    for t in range(steps - 1, -1, -1):
        f, c = f_all[grid[:, t]], c_all[grid[:, t]]
        over = (x >> top) >= f
        put[t], words[t] = over, x.astype(np.uint32)
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(BITS)) + (x - q * f) + c
        if t % checkpoint == 0:
            marks[t] = x.copy()
    out = []
    used = put.sum(axis=2)  # words of each step and block
    for b in range(blocks):
        part = ids[b * steps * lanes : (b + 1) * steps * lanes]
        own = words[:, b][put[:, b]]
        head = struct.pack("<III", len(part), zlib.crc32(part.astype("<u4").tobytes()), len(own))
        before = np.concatenate([[0], np.cumsum(used[:, b])])
        saved = b"".join(struct.pack("<I", int(before[t])) + marks[t][b].astype("<u8").tobytes() for t in sorted(marks))
        out.append(head + saved + own.astype("<u4").tobytes())
    return blocks, steps, out


def encode_frame(doc_ids: list[int | None], docs: list[bytes]) -> bytes:
    """A frame of whole documents, each given as its little-endian unsigned 32-bit ids."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    symbols, freq = frequency_table(ids) if len(ids) else (np.zeros(1, np.uint32), np.array([1 << BITS], np.uint32))
    blocks, steps, parts = encode_blocks(ids, symbols, freq)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    lengths = np.array([len(d) // 4 for d in docs], "<u4")
    # Symbols as gaps: small numbers, which deflate well.
    tables = zlib.compress(struct.pack("<I", len(symbols)) + np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    heads = zlib.compress(known.tobytes() + numbers.tobytes() + lengths.tobytes(), 6)
    head = _HEADER.pack(MAGIC, len(docs), len(ids), blocks, LANES, steps, CHECKPOINT)
    sizes = struct.pack("<II", len(tables), len(heads)) + np.array([len(p) for p in parts], "<u4").tobytes()
    body = head + sizes + tables + heads + b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Frame:
    """A parsed frame; ``decode`` gives all ids, ``decode_from`` those after a checkpoint."""

    def __init__(self, data: bytes):
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("checksum of a frame does not match")
        magic, self.n_docs, self.n_ids, self.blocks, self.lanes, self.steps, self.interval = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a frame")
        at = _HEADER.size
        n_tables, n_heads = struct.unpack_from("<II", data, at)
        at += 8
        sizes = np.frombuffer(data, "<u4", self.blocks, at)
        at += 4 * self.blocks
        tables = zlib.decompress(data[at : at + n_tables])
        at += n_tables
        (n_symbols,) = struct.unpack_from("<I", tables)
        self.symbols = np.cumsum(np.frombuffer(tables, "<u4", n_symbols, 4), dtype=np.uint32)
        self.freq = np.frombuffer(tables, "<u4", n_symbols, 4 + 4 * n_symbols)
        heads = zlib.decompress(data[at : at + n_heads])
        at += n_heads
        known = np.frombuffer(heads, np.uint8, self.n_docs)
        numbers = np.frombuffer(heads, "<i8", self.n_docs, self.n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
        self.lengths = np.frombuffer(heads, "<u4", self.n_docs, 9 * self.n_docs)
        self.parts = []
        for size in sizes:
            self.parts.append(data[at : at + int(size)])
            at += int(size)

    def _block(self, b: int) -> tuple[int, int, np.ndarray, list[tuple[int, np.ndarray]]]:
        part = self.parts[b]
        count, crc, n_words = struct.unpack_from("<III", part)
        at, marks = 12, []
        for _ in range(0, self.steps, self.interval):
            (before,) = struct.unpack_from("<I", part, at)
            marks.append((before, np.frombuffer(part, "<u8", self.lanes, at + 4).astype(np.uint64)))
            at += 4 + 8 * self.lanes
        return count, crc, np.frombuffer(part, "<u4", n_words, at), marks

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        return slots, self.freq.astype(np.uint64), (np.cumsum(self.freq, dtype=np.uint64) - self.freq).astype(np.uint64)

    def _run(self, blocks: list[tuple], mark: int, until: int) -> np.ndarray:
        """Symbol indexes of steps ``mark * interval`` to ``until`` of the given blocks."""
        slots, f_all, c_all = self._tables()
        lengths = [len(w) for _, _, w, _ in blocks]
        base = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        words = np.concatenate([*(w for _, _, w, _ in blocks), np.zeros(1, np.uint32)]).astype(np.uint64)
        x = np.stack([m[mark][1] for *_, m in blocks])
        at = base + np.array([m[mark][0] for *_, m in blocks])
        first, mask = mark * self.interval, np.uint64((1 << BITS) - 1)
        out = np.empty((until - first, len(blocks), self.lanes), np.uint32)
        for t in range(until - first):
            slot = x & mask
            s = slots[slot]
            out[t] = s
            x = f_all[s] * (x >> np.uint64(BITS)) + slot - c_all[s]
            need = x < LOW
            rank = np.cumsum(need, axis=1)
            where = at[:, None] + rank - 1
            x = np.where(need, (x << np.uint64(32)) | words[np.where(need, where, 0)], x)
            at = at + rank[:, -1]
        return out.transpose(1, 0, 2).reshape(len(blocks), -1)

    def decode(self) -> np.ndarray:
        blocks = [self._block(b) for b in range(self.blocks)]
        out = self._run(blocks, 0, self.steps)
        parts = []
        for (count, crc, _, _), row in zip(blocks, out, strict=True):
            ids = self.symbols[row[:count]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("checksum of a block does not match")
            parts.append(ids)
        return np.concatenate(parts)

    def decode_from(self, block: int, mark: int) -> np.ndarray:
        """The ids of one block from its checkpoint ``mark`` to the next one or the end."""
        one = self._block(block)
        row = self._run([one], mark, min(self.steps, (mark + 1) * self.interval))[0]
        return self.symbols[row[: max(0, one[0] - mark * self.interval * self.lanes)]]


def _encoder(path: str, end_id: int, frame: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), PieceEncoder.of(path)
        end = np.array([end_id], "<u4").tobytes()
        ids, docs, held, number, first = [], [], 0, 0, 0

        def flush():
            nonlocal ids, docs, held, number, first
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "frame": pa.array([number], pa.int64()), "first": pa.array([first], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "data": pa.array([encode_frame(ids, docs)], pa.binary())})
            ids, docs, first, held, number = [], [], first + held, 0, number + 1
            return row

        for batch in slices(batches, 4096):
            for doc_id, one in zip(batch.column(0).to_pylist(), encoder.encode_all(utf8(batch.column(1))), strict=True):
                one += end
                if docs and held + len(one) // 4 > frame:
                    yield flush()
                ids.append(doc_id)
                docs.append(one)
                held += len(one) // 4
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, frame: int = FRAME) -> None:
    """Writes the ids of ``docs`` (doc_id, text) as frames under ``path`` in doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows of one doc_id are dealt by their texts and, where these are equal, by where they were read.
    rows = rows.withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(_encoder(tokenizer_path or default_path(), end_id, frame), FRAMES).write.option("compression", "none").parquet(path)


def _decoder(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            frame = Frame(row["data"])
            ids = frame.decode().astype("<u4")
            ends = np.cumsum(frame.lengths, dtype=np.int64)
            begins = ends - frame.lengths
            n = frame.n_docs
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([row["shard"]] * n, pa.int64()),
                    "doc_id": pa.array(frame.doc_ids, pa.int64()),
                    "start": pa.array(begins + row["first"], pa.int64()),
                    "n_tokens": pa.array(frame.lengths.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(ids[b:e]) for b, e in zip(begins, ends, strict=True)], pa.int64()),
                }
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the frames under ``path``: a row per document with its start, length and CRC-32.

    ``start`` adds the ids of earlier shards; there is one sum per shard, and shards are at
    most ``spark.sql.shuffle.partitions``, so their table is small by construction.
    """
    frames = spark.read.schema(FRAMES).parquet(path)
    sums = frames.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("base"))
    docs = frames.select("shard", "first", "data").mapInArrow(_decoder, DECODED)
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
