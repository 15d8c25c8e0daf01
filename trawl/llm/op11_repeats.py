"""Removal of repeated passages with prefix-partitioned suffix trees.

A passage repeats if a window of so many words in a row also starts somewhere else. The
suffixes of all texts that can hold such a window are split by a prefix of varying length: a
suffix's prefix ends with its window's anchor, the one of the window's runs of ``ANCHOR``
words whose hash is least. Equal windows have equal prefixes, so a suffix tree of the suffixes
of some prefixes knows all repeats among them. Neighbouring suffixes mostly end their
prefixes with one anchor, so they travel as one piece of text, and anchors that occur once
are left behind: nothing can repeat there.

Anchors are dealt to groups that fit into a task's memory. A group's tree is built over whole
words from the top: nodes of a depth are named by the pair of the names of their halves, and
a suffix that is alone below its node is cut off there. The internal nodes that reach the
window's depth are the repeats, and all their leaves are removed. An anchor of so many
suffixes that it would overfill a group takes the longest prefix, the whole window: below it
there is one node, so counting its suffixes is all its tree can say.

Equal texts are folded first: all windows of a text that occurs twice repeat, and one of them
stands for all in the trees.

Defined cases: words are maximal runs of characters other than ASCII white space, compared
unchanged; null and empty texts have no words; texts of fewer words than a window lose none;
occurrences may overlap; rows are documents of their own, also with repeated or null doc_id,
so equal rows of enough words lose all their words; kept words are joined by one space; texts
of any length are read whole; an empty table gives no rows; other columns of any name pass
through, but for n_words and n_removed, which are replaced.

Texts are told apart by 128 bits of hashes, anchors by 64 (two anchors with one hash only meet
in a group), windows of overfull anchors by 128; inside trees words are compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import forget, small_batches, stored, table
from trawl.llm.spans import SPACE, gathered, groups, owners, run_hashes, sizes_of, spans, word_hashes

WINDOW = 35
#: Words of an anchor, at most.
ANCHOR = 8
#: Bytes of pieces in a group, about; an anchor with more is overfull.
GROUP_BYTES = 8 << 20
#: Texts that are cut into pieces at a time, at most, and their bytes (pieces have several times as many).
PIECE_ROWS, PIECE_BYTES = 500, 1 << 19
#: Windows whose anchors are looked for at a time.
SEGMENT = 1 << 19
RUN = "array<struct<g:long,s:int,n:int>>"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` values in a row stands, the first one of equals."""
    best = np.arange(len(values), dtype=np.int32)
    size = 1
    while size < width:
        step = min(size, width - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        size += step
    return best


def anchor_runs(hashes: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first window, windows) for each run of windows with one anchor.

    ``hashes`` are those of the words of all texts in a row, ``owner`` their texts' numbers.
    """
    k = min(ANCHOR, window)
    found: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, max(0, len(hashes) - window + 1), SEGMENT):
        own = slice(at, at + SEGMENT + window - 1)
        g, text = run_hashes(hashes[own], k), owner[own]
        whole = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :])
        if not len(whole):
            continue
        anchor = _least(g, window - k + 1)[whole]
        first = np.flatnonzero(np.concatenate([[True], np.diff(anchor) != 0]))
        for values, value in zip(found, (g[anchor[first]], whole[first] + at, np.diff(np.append(first, len(whole)))), strict=True):
            values.append(value)
    return tuple(np.concatenate([np.empty(0, np.uint64 if i == 0 else np.int64), *v]) for i, v in enumerate(found))


def _runs(window: int):
    schema = pa.list_(pa.struct([("g", pa.int64()), ("s", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, 2):
            raw, begins = sizes_of(batch.column(2))
            starts, ends = spans(raw, begins, SPACE)
            owner = owners(begins, starts)
            bases = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            g, s, n = anchor_runs(word_hashes(raw, starts, ends), owner, window)
            of = owner[s]
            values = pa.StructArray.from_arrays([pa.array(g.view(np.int64)), pa.array((s - bases[of]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["g", "s", "n"])
            offsets = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.diff(bases), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values).cast(schema)], names=["t1", "t2", "n_words", "runs"])

    return run


def _pieces(window: int):
    """The words of each run's windows, joined by single spaces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, 0, PIECE_BYTES):
            raw, begins = sizes_of(batch.column(0))
            starts, ends = spans(raw, begins, SPACE)
            bases = np.searchsorted(owners(begins, starts), np.arange(batch.num_rows))
            wanted = batch.column(2)
            values, offsets = wanted.flatten(), wanted.offsets.to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            s, n = (values.field(i).to_numpy() for i in (1, 2))
            if not len(s):
                continue
            first = bases[of] + s
            low, high = starts[first], ends[first + n + window - 2]
            texts = []
            tight = np.zeros(len(starts), np.int64)  # words that more than one space follows
            tight[:-1] = (starts[1:] - ends[:-1] != 1) | (raw[np.minimum(ends[:-1], len(raw) - 1)] != 32)
            odd = np.concatenate([[0], np.cumsum(tight)])
            odd = odd[first + n + window - 2] - odd[first]
            whole = raw.tobytes()
            for b, e, o in zip(low.tolist(), high.tolist(), odd.tolist(), strict=True):
                texts.append(b" ".join(whole[b:e].split()) if o else whole[b:e])
            tid = batch.column(1).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([tid, values.field(0), values.field(1), values.field(2), values.field(3), pa.array(texts, pa.binary())], names=["tid", "g", "s", "n", "over", "piece"])

    return run


def deep_nodes(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each of ``starts`` the number of the suffix tree's internal node at ``depth`` words
    above it, -1 for suffixes that are cut off before.

    ``words`` are word numbers. A node of depth a + b has the name of the pair of its first a
    and next b words' names; after each doubling, suffixes alone below their node are leaves.
    """
    nodes = np.full(len(starts), -1, np.int64)
    alive = np.arange(len(starts))
    names, size = words.astype(np.int64), 1
    while True:
        _, own, many = np.unique(names[starts[alive]], return_inverse=True, return_counts=True)
        inner = many[own] > 1
        alive, own = alive[inner], own[inner]
        if not len(alive) or size == depth:
            nodes[alive] = own
            return nodes
        step = min(size, depth - size)
        # Names are only needed where a suffix that is still alive passes.
        needed = np.zeros(len(names) + depth, bool)
        for at in range(0, depth - size - step + 1, 1):
            needed[starts[alive] + at] = True
        at = np.flatnonzero(needed[: len(names)])
        at = at[at + step < len(names)]
        pairs = names[at] * (int(names.max()) + 1) + names[at + step]
        longer = np.zeros(len(names), np.int64)
        longer[at] = np.unique(pairs, return_inverse=True)[1]
        names, size = longer, size + step


def stretches(hit: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of true values within one piece."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    new = np.flatnonzero((np.diff(at) != 1) | (np.diff(of[at]) != 0)) + 1
    return at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])]


def _tree(window: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        pieces = rows.column("piece").chunk(0)
        raw, begins = sizes_of(pieces)
        starts, ends = spans(raw, begins, SPACE)
        words = gathered(raw, starts, ends).dictionary_encode().indices.to_numpy()
        bases = np.searchsorted(owners(begins, starts), np.arange(len(pieces)))
        n, s = (rows.column(c).chunk(0).to_numpy().astype(np.int64) for c in ("n", "s"))
        of = np.repeat(np.arange(len(pieces)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        nodes = deep_nodes(words, bases[of] + within, window)
        first, last = stretches(nodes >= 0, of)
        tid = rows.column("tid").chunk(0).take(pa.array(of[first]))
        low = s[of[first]] + within[first]
        return pa.table({"tid": tid, "low": pa.array(low, pa.int64()), "high": pa.array(low + last - first, pa.int64())})

    return run


def _windows(window: int):
    """All windows of pieces under the longest prefix: 128 bits of each one's hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, 2, 1 << 18):
            raw, begins = sizes_of(batch.column(2))
            starts, ends = spans(raw, begins, SPACE)
            bases = np.searchsorted(owners(begins, starts), np.arange(batch.num_rows))
            n = np.diff(np.append(bases, len(starts))) - window + 1
            of = np.repeat(np.arange(batch.num_rows), n)
            within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at, whole = bases[of] + within, raw.tobytes()
            digests = b"".join([xxhash.xxh3_128_digest(whole[b:e]) for b, e in zip(starts[at].tolist(), ends[at + window - 1].tolist(), strict=True)])
            w = np.frombuffer(digests, np.int64).reshape(-1, 2)
            low = batch.column(1).to_numpy()[of] + within
            yield pa.RecordBatch.from_arrays([pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), batch.column(0).take(pa.array(of)), pa.array(low, pa.int64())], names=["w1", "w2", "tid", "low"])

    return run


def _text_key(text: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(11), text).alias("t2")]


def repeats(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row per distinct text: t1, t2, n (rows with it), n_words and ``spans``, the (low, high)
    of first and last windows in a row that repeat among the distinct texts; stored."""
    keyed = docs.select(*_text_key(F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    runs = keyed.mapInArrow(_runs(window), f"t1 long, t2 long, n_words long, runs {RUN}")
    texts = runs.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words"), F.first("runs").alias("runs"))
    with small_batches(docs.sparkSession):
        texts = stored(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    anchors = texts.select("tid", F.explode("runs").alias("x")).select("tid", "x.g", "x.s", "x.n")
    # Bytes of an anchor's pieces, from their words.
    sizes = anchors.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") + window - 1).alias("words")).filter("k > 1")
    sizes = sizes.select("g", (F.col("words") * 7 > group_bytes).alias("over"))
    found = anchors.join(sizes, "g").groupBy("tid").agg(F.collect_list(F.struct("g", "s", "n", "over")).alias("wanted"))
    wanted = texts.select("tid", "t1", "t2").join(found, "tid")
    once = keyed.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(wanted, ["t1", "t2"])
    with small_batches(docs.sparkSession, PIECE_ROWS):
        pieces = stored(once.select("text", "tid", "wanted").mapInArrow(_pieces(window), "tid long, g long, s int, n int, over boolean, piece binary"), "pieces")
    held = pieces.filter("NOT over").agg(F.sum(F.length("piece")).alias("bytes")).first().bytes or 0
    own = pieces.filter("NOT over").withColumn("group", F.pmod(F.xxhash64("g"), F.lit(1 + held // group_bytes)))
    shallow = own.select("group", "tid", "s", "n", "piece").groupBy("group").applyInArrow(_tree(window), "tid long, low long, high long")
    single = pieces.filter("over").select("tid", "s", "piece").mapInArrow(_windows(window), "w1 long, w2 long, tid long, low long")
    again = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("w1", "w2")
    deep = single.join(again, ["w1", "w2"]).select("tid", "low", F.col("low").alias("high"))
    hits = shallow.unionByName(deep).groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    out = stored(texts.select("tid", "t1", "t2", "n", "n_words").join(hits, "tid", "left").drop("tid"), "repeats")
    forget(texts, pieces)
    return out


def kept_text(text: bytes, covered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([text[b:e] for b, e in zip(starts[~covered].tolist(), ends[~covered].tolist(), strict=True)])


def _keeper(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "text", "n_words", "n_removed"]
        for batch in groups(batches, 1):
            raw, begins = sizes_of(batch.column(1))
            starts, ends = spans(raw, begins, SPACE)
            bases = np.searchsorted(owners(begins, starts), np.arange(batch.num_rows + 1))
            sizes = np.diff(bases)
            change = np.zeros(len(starts) + 1, np.int64)
            whole = batch.column(2).to_numpy(zero_copy_only=False) & (sizes >= window)
            for i in np.flatnonzero(whole).tolist():
                change[bases[i]] += 1
                change[bases[i + 1]] -= 1
            marks = batch.column(3)
            if len(values := marks.flatten()):
                counts = pc.fill_null(pc.list_value_length(marks), 0).to_numpy()
                of = np.repeat(np.arange(batch.num_rows), counts)
                np.add.at(change, bases[of] + values.field(0).to_numpy(), 1)
                np.add.at(change, bases[of] + values.field(1).to_numpy() + window, -1)
            covered = np.cumsum(change[:-1]) > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[bases])
            data, texts = raw.tobytes(), []
            for i in range(batch.num_rows):
                own = slice(int(bases[i]), int(bases[i + 1]))
                texts.append(kept_text(data, covered[own], starts[own], ends[own]) if removed[i] < sizes[i] else b"")
            text = pa.array(texts, pa.large_binary() if sum(map(len, texts)) >= 1 << 31 else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with ``text`` replaced by the words that no repeated window covers, joined by one
    space, and n_words and n_removed added."""
    found = repeats(docs.select("text"), window, group_bytes).filter("n > 1 OR spans IS NOT NULL")
    others = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    rows = docs.select(*_text_key(F.col("text")), F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(found.select("t1", "t2", (F.col("n") > 1).alias("copied"), "spans"), ["t1", "t2"], "left")
    rows = rows.select("row", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = rows.mapInArrow(_keeper(window), schema)
    text = F.col("text").cast("string").alias("text")
    columns = [text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return done.select(*columns, "n_words", "n_removed")


def op11_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
