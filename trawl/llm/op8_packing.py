"""Best-fit packing by large-item matching.

Documents are encoded, given an end id and cut into pieces of at most ``capacity`` ids. How
many pieces there are of each length decides the whole packing, and there are at most
``capacity`` lengths, so the plan is made from that histogram alone: pieces longer than a
third of the capacity go at most two to a sequence, each longest one with the longest that
still fits beside it; shorter pieces, longest first, go to the smallest gap that holds them,
and open a new sequence where none does. Spark numbers the pieces of each length (in salted
runs, so a frequent length is not one group) and joins them to the plan's runs.

Defined cases: null text counts as empty (one piece of the end id); an empty table gives no
rows; rows with equal doc_id are packed each on its own; a long text is encoded whole and cut
into as many pieces as it takes; pieces of equal length may stand in for each other, so which
goes where follows from their doc_id, piece and place in the stored table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import slices, small_batches, stored, table, utf8
from trawl.llm.tokens import PieceEncoder, default_path

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are numbered together, about.
CELL = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
#: Pieces of ``length`` with rank in [rank_from, rank_from + pieces) go to sequences from
#: ``sequence`` on, ``each`` to a sequence, the first of them at ``offset``.
PLAN = "length long, rank_from long, pieces long, sequence long, each long, offset long"


def _cutter(path: str, capacity: int, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, row = PieceEncoder.of(path), np.array([end_id], "<u4").tobytes(), 0
        for batch in slices(batches, 4096):
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(utf8(batch.column(1))), strict=True):
                ids += end
                n = len(ids) // 4
                pieces = -(-n // capacity)
                cut = n - capacity * (pieces - 1)  # the first piece takes what is left over
                start = 0
                for k in range(pieces):
                    stop = cut + capacity * k
                    for values, value in zip(rows, (doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), row), strict=True):
                        values.append(value)
                    row += 1
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return run


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cutter(tokenizer_path or default_path(), capacity, end_id), PIECES)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """The plan's runs from the number of pieces of each length.

    Sequences that are filled alike form one run of numbers, so the plan's size depends on the
    number of different lengths, never on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    given = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free ids -> runs of sequences (first, how many)
    sizes: list[int] = []  # the keys of gaps, ascending
    opened = 0

    def put(length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        plan.append((length, given[length], pieces, sequence, each, offset))
        given[length] += pieces
        left[length] -= pieces

    def free(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect_left(large, capacity - n + 1) - 1
            while at >= 0 and (left[large[at]] - (large[at] == n) <= 0):
                at -= 1
            mate = large[at] if at >= 0 and large[at] <= n else None
            if mate is None:
                many = left[n]
                put(n, many, opened, 1, 0)
                free(capacity - n, opened, many)
            elif mate == n:
                many = left[n] // 2
                put(n, 2 * many, opened, 2, 0)
                free(capacity - 2 * n, opened, many)
            else:
                many = min(left[n], left[mate])
                put(n, many, opened, 1, 0)
                put(mate, many, opened, 1, n)
                free(capacity - n - mate, opened, many)
            opened += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at == len(sizes):
                each = capacity // n
                many = max(1, left[n] // each)
                each = min(each, left[n])
                put(n, each * many, opened, each, 0)
                free(capacity - each * n, opened, many)
                opened += many
                continue
            gap = sizes[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            each = min(gap // n, left[n])  # best fit stays with a gap that it has begun to fill
            used = min(many, left[n] // each)
            put(n, each * used, first, each, capacity - gap)
            free(gap - each * n, first, used)
            free(gap, first + used, many - used)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, cell_size: int = CELL) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces.

    Pieces of a length are numbered within a salt; salts are as many as keep the most frequent
    length's cells at about ``cell_size`` pieces. A piece's salt hangs on its place in the task
    that cut it, too, so a document that repeats is in many of them.
    """
    spark = pieces.sparkSession
    # At most ``capacity`` rows: lengths are 1 to capacity.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(16, -(-max(counts.values(), default=0) // cell_size))
    cell = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(salts)))
    sums = cell.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    plan = spark.createDataFrame(plan_packing(counts, capacity), PLAN)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "row", "start", "ids_crc32")
    ranked = cell.withColumn("_row", F.row_number().over(within) - 1)
    ranked = ranked.join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_row") + F.col("_base"))
    # The plan has a bounded number of rows (see plan_packing), whatever the corpus.
    runs = plan.select(F.col("length").alias("_length"), "rank_from", "pieces", "sequence", "each", "offset")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_from") + F.col("pieces"))
    step = F.col("_rank") - F.col("rank_from")
    return ranked.join(F.broadcast(runs), on).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.expr("(_rank - rank_from) div each")).alias("sequence_id"),
        (F.col("offset") + (step % F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """Encodes, cuts and packs ``docs`` (doc_id, text); a row per piece."""
    with small_batches(docs.sparkSession):
        pieces = stored(cut_pieces(docs, capacity, end_id, tokenizer_path), "pieces")
    return pack(pieces, capacity)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
