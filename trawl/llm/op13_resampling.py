"""Resampling of documents by importance towards a target text, with segments counted once.

Features are runs of one or two words, hashed into buckets; a bucket's gain says how much more
frequent it is in the target than in the corpus. Newlines cut a text into lines, and most
counting is done by line: each different line is stored once with the number of its
occurrences, its features are counted once and multiplied by that number, and its sum of gains
is computed once and joined to the documents that hold it. Runs of two words that cross a
newline belong to no line; they are found in the whole texts and added separately. Documents
are drawn without replacement by their mean gain plus Gumbel noise of their id.

Nothing is ranked in one place: rows are dealt out by ranges of the score, numbered within
their range, and shifted by the sizes of the ranges before.

Defined cases: words are maximal runs of a-z, 0-9 and characters beyond ASCII, after A-Z have
been lower-cased; null and empty texts have no features and weight 0; a run of two words goes
on across empty lines, and any other separators; rows with equal doc_id or text are each weighed and
drawn; a null doc_id has the hash of an empty one and comes last among equal scores; an empty
corpus gives no rows, an empty target only makes all its counts 0; texts and lines of any
length are read whole; columns other than doc_id and text are ignored, whatever their names.

Lines and texts are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import forget, stored, table
from trawl.llm.spans import byte_table, groups, lowered, owners, sizes_of, spans

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SEPARATORS = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Words of up to so many bytes are hashed by array operations.
SHORT = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _zeros() -> np.ndarray:
    """What so many zero bytes make of each byte of a register: [bytes][place][value]."""
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHORT):
        out[n + 1] = _step(out[n], 0)
    return out


_ZEROS = _zeros()


def word_states(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 register after each word (not inverted); only of words of up to SHORT bytes."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, SHORT + 1), kind="stable")
    order = order[np.searchsorted(-sizes[order], -SHORT) :]
    at, left = starts[order], sizes[order]
    state = np.full(len(order), _ONES, np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        many = int(np.searchsorted(-left, -j))
        state[:many] = _step(state[:many], raw[at[:many] + j])
    out = np.zeros(len(starts), np.uint32)
    out[order] = state
    return out


def word_buckets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray, buckets: int) -> np.ndarray:
    crcs = states ^ _ONES
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        crcs[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    return (crcs % np.uint32(buckets)).astype(np.int64)


def pair_buckets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray, first: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the words at ``first`` each joined with the next one by a space: the second
    word's register is shifted over the first one's instead of reading its bytes again."""
    sizes = ends - starts
    n = np.minimum(sizes[first + 1], SHORT)
    carried = _step(states[first], 32) ^ _ONES
    crcs = states[first + 1] ^ _ONES
    for k in range(4):
        crcs ^= _ZEROS[n, k, (carried >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(np.maximum(sizes[first], sizes[first + 1]) > SHORT).tolist():
        a = int(first[i])
        crcs[i] = zlib.crc32(raw[starts[a + 1] : ends[a + 1]].tobytes(), zlib.crc32(raw[starts[a] : ends[a]].tobytes() + b" "))
    return (crcs % np.uint32(buckets)).astype(np.int64)


def features(column: pa.Array, crossing: bool, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, bucket) of each feature: all of them, or those that cross a newline."""
    raw, begins = sizes_of(column)
    low = lowered(raw)
    starts, ends = spans(low, begins, SEPARATORS)
    owner = owners(begins, starts)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    if crossing:
        lines = np.cumsum(raw == 10)[starts]
        pairs = pairs[lines[pairs + 1] != lines[pairs]]
        # Only the words beside a newline are hashed.
        used = np.unique(np.concatenate([pairs, pairs + 1]))
        starts, ends, owner, pairs = starts[used], ends[used], owner[used], np.searchsorted(used, pairs)
    states = word_states(low, starts, ends)
    both = pair_buckets(low, starts, ends, states, pairs, buckets)
    if crossing:
        return owner[pairs], both
    return np.concatenate([owner, owner[pairs]]), np.concatenate([word_buckets(low, starts, ends, states, buckets), both])


def _counts(crossing: bool, buckets: int):
    """(bucket, n) of a task's texts; the second column is how often each text occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in groups(batches, 0):
            of, bucket = features(batch.column(0), crossing, buckets)
            if crossing:
                sums += np.bincount(bucket, minlength=buckets)
            else:
                np.add.at(sums, bucket, batch.column(1).to_numpy()[of])
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used], pa.int64())], names=["bucket", "n"])

    return run


def _sums(crossing: bool, gains: np.ndarray):
    """Number of features and sum of gains of each text, beside its two keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, 0):
            of, bucket = features(batch.column(0), crossing, len(gains))
            gain = np.zeros(batch.num_rows, np.int64)
            np.add.at(gain, of, gains[bucket])
            n = np.bincount(of, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(gain, pa.int64())], names=["k1", "k2", "n", "gain"])

    return run


def _keys(value: Column, *names: str) -> list[Column]:
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(13), value).alias(names[1])]


def _whole(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def segments(docs: DataFrame) -> DataFrame:
    """A row per line: t1, t2 (its text), first (of its text), k1, k2 (the line) and the line."""
    text = _whole(docs)
    lines = docs.select(*_keys(text, "t1", "t2"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return lines.select("t1", "t2", (F.col("pos") == 0).alias("first"), *_keys(F.col("line"), "k1", "k2"), "line")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """Each different line once, with its number of occurrences; stored."""
    lines = segments(docs).groupBy("k1", "k2").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("copies"))
    return stored(lines, "lines")


def bucket_counts(docs: DataFrame, lines: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``docs`` each bucket has; ``lines`` are their distinct lines."""
    within = lines.select("line", "copies").mapInArrow(_counts(False, buckets), "bucket long, n long")
    across = docs.select(_whole(docs).alias("text")).mapInArrow(_counts(True, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in within.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = int(corpus.sum()), int(target.sum())
    buckets = len(corpus)
    ratio = lambda a, b: float((b + 1) * (s + buckets)) / float((a + 1) * (t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def text_sums(docs: DataFrame, lines: DataFrame, gains: np.ndarray) -> DataFrame:
    """(t1, t2, n_features, weight) of each different text."""
    kind = "k1 long, k2 long, n long, gain long"
    by_line = lines.select("line", "k1", "k2").mapInArrow(_sums(False, gains), kind)
    within = segments(docs).select("t1", "t2", "first", "k1", "k2").join(by_line, ["k1", "k2"]).select("t1", "t2", "first", "n", "gain")
    text = _whole(docs)
    across = docs.select(text.alias("text"), *_keys(text, "k1", "k2")).mapInArrow(_sums(True, gains), kind)
    both = within.unionByName(across.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.lit(False).alias("first"), "n", "gain"))
    # Rows of equal texts add up alike; each has one first line.
    sums = both.groupBy("t1", "t2").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"), F.count_if("first").alias("rows"))
    sums = sums.select("t1", "t2", F.expr("n div rows").alias("n"), F.expr("gain div rows").alias("gain"))
    mean = F.expr("(gain - pmod(gain, n)) div n")
    return sums.select("t1", "t2", F.col("n").alias("n_features"), F.when(F.col("n") > 0, mean).otherwise(F.lit(0)).cast("long").alias("weight"))


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, from 1 in the given order over all of them; stored."""
    sorted_ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    base, bases = 0, []
    for r in sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row per partition
        bases.append((r.part, base))
        base += r.n
    bases = F.broadcast(rows.sparkSession.createDataFrame(bases, "_part long, _base long"))
    return sorted_.join(bases, part == F.col("_part")).withColumn("place", F.col("_base") + within + 1).drop("_at", "_part", "_base")


def weighed(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """A row per document: doc_id, n_features, weight, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines, wanted = distinct_lines(docs), distinct_lines(target)
    gains = bucket_gains(bucket_counts(docs, lines, buckets), bucket_counts(target, wanted, buckets))
    sums = stored(text_sums(docs, lines, gains), "weights")
    forget(lines, wanted)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = docs.select("doc_id", *_keys(_whole(docs), "t1", "t2"), noise.alias("noise")).join(sums, ["t1", "t2"])
    return rows.select("doc_id", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """``weighed`` with ``rank``: the place of each drawn document, null for the others."""
    rows = stored(weighed(docs, target, **options), "weighed")
    # A text of w words has 2 w - 1 features.
    enough = F.col("n_features") >= 2 * min_words - 1
    drawn = percent * rows.filter(enough).count() // 100
    placed = in_order(rows.filter(enough), F.desc("score"), F.asc_nulls_last("doc_id"))
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    return placed.withColumn("rank", rank).drop("place").unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_HALF = "(CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END)"
ORACLE = f"""
WITH RECURSIVE k(n, c, i) AS (SELECT n, n, 0 FROM range(256) r(n) UNION ALL SELECT n, {_HALF.format(x='c')}, i + 1 FROM k WHERE i < 8),
z AS (SELECT list(c ORDER BY n) AS t FROM k WHERE i = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
f AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x, 1 AS own FROM d
      UNION ALL SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))), 0 FROM b),
x AS (SELECT x, hex(encode(x)) AS hx, octet_length(encode(x)) AS n FROM (SELECT DISTINCT x FROM f)),
c AS (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || substr(hx, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
        lambda a, y: xor(z.t[(xor(a, y) & 255) + 1], a >> 8)), 4294967295) % {BUCKETS} AS bucket FROM x, z),
g AS (SELECT f.r, f.own, c.bucket FROM f JOIN c ON f.x = c.x),
s AS (SELECT bucket, count(*) FILTER (WHERE own = 1) AS s, count(*) FILTER (WHERE own = 0) AS t FROM g GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM s),
v AS (SELECT bucket, CAST(floor(1000 * ln(((s.t + 1) * (a.s + {BUCKETS}))::DOUBLE / ((s.s + 1) * (a.t + {BUCKETS}))::DOUBLE)) AS BIGINT) AS gain FROM s, a),
w AS (SELECT g.r, count(*) AS n, sum(v.gain)::BIGINT AS total FROM g JOIN v ON g.bucket = v.bucket WHERE own = 1 GROUP BY g.r),
o AS (SELECT d.r, d.doc_id, coalesce(w.n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, len(d.w) >= {MIN_WORDS} AS enough,
        CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN w ON d.r = w.r),
p AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY weight + noise DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE enough) OVER () AS many FROM o)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
       CASE WHEN enough AND place <= {PERCENT} * many // 100 THEN place END::BIGINT AS rank FROM p
"""
