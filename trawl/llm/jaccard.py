"""Exact joins of texts by the Jaccard similarity of their shingle sets, 0.8 or more.

Prefix filter: with all shingles in one total order, two sets of that similarity share one
within the first n - ceil(0.8 n) + 1 of each, and large sets share several there. Any order is right; here shingles that many
texts of a sample hold come last, the others go by their hash. Texts that share such a shingle
and are of fitting sizes are candidates. A set's parities (of the number of its shingles in each of BITMAP
places) differ in at most as many places as two sets differ in shingles, so most candidates go
by these alone; the sets of the others are compared whole. Larger sets have more places.

Candidates already in one component are passed over. While there are more pairs than texts in
them, a round takes one pair for each text: of the texts that lead its shingles' groups, the
one that leads most of them. That folds large groups of copies with as many comparisons as
texts. Rounds go on as long as they fold; the last one looks at all pairs that are left, so none
is missed. Many texts can be left in one shingle's group that are almost similar enough, each to
each. So the group is cut into blocks by hash, and tasks compare two blocks at a time by their
parities; only pairs that these let through become rows.

Spark sizes stored tables by their compressed files, and shingles taken out of an array by the
array's one value, so it would broadcast what the driver cannot hold: the joins of shingles,
parities and words are merge joins by hint.

Shingles and the words of a whole text are known by 64-bit hashes. Texts without words have no
shingles and no pairs here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm import op3_simhash as simhash
from trawl.llm.common import forget, slices, stored, utf8

#: One text in SAMPLE is looked at for common shingles; at most COMMON of them are told apart.
SAMPLE, COMMON, SEEN = 16, 65_536, 2
#: Pairs for each text that need no further round, and the part of the rows that a round must
#: leave behind to be followed by another.
DENSE, FOLDS = 1, 16
BITMAP = 512
#: About as many texts of one shingle's group are held against as many others at a time.
BLOCK = 256


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(np.frombuffer(simhash.shingle_hashes(text, shingle), np.int64))


class Order:
    """The order of shingles: by hash, but ``common`` ones last, in the order given."""

    def __init__(self, common: np.ndarray):
        at = np.argsort(common)
        self.common, self.rank = common[at], at + 1

    def prefixes(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """The first shingles of each of the sorted sets."""
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *sets])
        rank = np.zeros(len(flat), np.int64)
        if len(self.common):
            place = np.minimum(np.searchsorted(self.common, flat), len(self.common) - 1)
            late = self.common[place] == flat
            rank[late] = self.rank[place[late]]
        of = np.repeat(np.arange(len(sets)), sizes)
        order = np.lexsort((rank, of))  # stable, and each set comes in order of hash
        first = np.cumsum(sizes) - sizes
        return [flat[order[b : b + prefix_size(n)]] for b, n in zip(first.tolist(), sizes.tolist(), strict=True)]


def parities(ids: np.ndarray) -> bytes:
    """Whether the number of shingles is odd in each of as many places as there are shingles
    (a power of two, at least BITMAP): one bit for each place."""
    places = max(BITMAP, 1 << max(0, len(ids) - 1).bit_length())
    return np.packbits(np.bincount(ids.view(np.uint64) % places, minlength=places) % 2 == 1).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities in fewer places: those of a place and of the one half the places further on."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def differing(s: list[bytes], t: list[bytes]) -> np.ndarray:
    """In how many places the parities of each pair differ, in the smaller one's places."""
    out = np.zeros(len(s), np.int64)
    least = BITMAP // 8
    small = np.array([len(x) == len(y) == least for x, y in zip(s, t, strict=True)], bool)
    if small.any():
        x, y = (np.frombuffer(b"".join([v[i] for i in np.flatnonzero(small)]), np.uint64).reshape(-1, BITMAP // 64) for v in (s, t))
        out[small] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    for i in np.flatnonzero(~small).tolist():
        x, y = np.frombuffer(s[i], np.uint8), np.frombuffer(t[i], np.uint8)
        size = min(len(x), len(y))
        out[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)
    return out


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 5 * both >= 4 * (len(x) + len(y) - both)


def _sets(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.concatenate([shingle_set(t, shingle) for t in utf8(batch.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["token"])

    return run


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of at least SEEN texts of the sample, rarest first."""
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = sample.mapInArrow(_sets(shingle), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN)
    # Collected straight away, COMMON of each task would go to the driver.
    chosen = stored(counts.orderBy(F.desc("n"), "token").limit(COMMON), "common")
    rows = sorted(chosen.collect(), key=lambda r: (r.n, -r.token))
    forget(chosen)
    return np.array([r.token for r in rows], np.int64)


def _marks(shingle: int, common: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(common)
        for batch in slices(batches):
            texts = utf8(batch.column(3))
            hashes = [simhash.shingle_hashes(t, shingle) for t in texts]
            sets = [np.unique(np.frombuffer(h, np.int64)) for h in hashes]
            prefixes = order.prefixes(sets)
            keys = [xxhash.xxh64_intdigest(b" ".join((t or b"").lower().split())) for t in texts]
            signed = [pa.array(np.array(v, np.uint64).view(np.int64), pa.int64()) for v in (list(map(simhash.majority, hashes)), keys)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes]), pa.int64()))
            bits = list(map(parities, sets))
            least = [folded(np.frombuffer(b, np.uint8), BITMAP // 8).tobytes() for b in bits]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, pa.binary()), pa.array(least, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *signed, *columns], names=["doc_id", "_id", "_th", "fp", "tk", "n", "bits", "least", "prefix"])

    return run


def marked(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc_id, _id, _th, text) with fingerprint, hash of the words, set size and prefix."""
    return texts.mapInArrow(_marks(shingle, common_shingles(texts, shingle)), "doc_id long, _id long, _th long, fp long, tk long, n long, bits binary, least binary, prefix array<long>")


def _close(rows: pa.Table) -> pa.Table:
    """Pairs of rows of one cell, of unlike sides where it has two, that parities in BITMAP places let through."""
    cell, side, n, root = (rows.column(c).to_numpy() for c in ("cell", "side", "n", "root"))
    token, bits = rows.column("token").to_numpy(), np.frombuffer(b"".join(rows.column("least").to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
    ends = np.flatnonzero(np.append((token[1:] != token[:-1]) | (cell[1:] != cell[:-1]), True)) + 1
    end = np.repeat(ends, np.diff(ends, prepend=0))
    first, second, at, step = [], [], np.arange(len(token)), 0
    while True:  # each row with the one a step further on
        step += 1
        at = at[at + step < end[at]]
        if not len(at):
            break
        to = at + step
        total = n[at] + n[to]
        fits = (root[at] != root[to]) & ((side[at] < 0) | (side[at] != side[to])) & (5 * np.minimum(n[at], n[to]) >= 4 * np.maximum(n[at], n[to]))
        x, y, total = at[fits], to[fits], total[fits]
        near = 9 * np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= total
        first.append(x[near])
        second.append(y[near])
    key, empty = rows.column("tk").to_numpy(), np.empty(0, np.int64)
    x, y = np.concatenate([empty, *first]), np.concatenate([empty, *second])
    x, y = np.where(key[x] < key[y], x, y), np.where(key[x] < key[y], y, x)
    columns = [rows.column(c).to_numpy()[of] for of in (x, y) for c in ("tk", "fp", "n")]
    return pa.table(columns, names=["tk", "fp", "n", "tk2", "fp2", "n2"])


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_close`` for rows in order of token and cell; a cell may go on in the next batch."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        token, cell = (rows.column(c).to_numpy() for c in ("token", "cell"))
        other = np.flatnonzero((token != token[-1:]) | (cell != cell[-1:]))
        cut = int(other[-1]) + 1 if len(other) else 0
        kept = rows.slice(cut)
        if cut:
            yield from _close(rows.slice(0, cut)).to_batches()
    if kept is not None and len(kept):
        yield from _close(kept).to_batches()


def close_pairs(members: DataFrame, sizes: DataFrame, own: DataFrame) -> DataFrame:
    """A row for each shingle and each pair of its texts, of unlike roots, that may be similar.

    A text of a group of k goes to ceil(k / BLOCK) cells, one for each block that its own is
    compared with.
    """
    blocks = F.ceil(F.col("k") / BLOCK)
    rows = members.hint("merge").join(own.select("tk", "least"), "tk").hint("merge").join(sizes, "token").withColumn("b", blocks).withColumn("i", F.pmod(F.xxhash64("tk"), F.col("b")))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
    cell = F.least("i", "j") * F.col("b") + F.greatest("i", "j")
    side = F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("i"))  # in a block's own cell all are compared
    rows = rows.select("token", cell.alias("cell"), side.alias("side"), "tk", "fp", "n", "root", "least")
    return rows.repartition("token", "cell").sortWithinPartitions("token", "cell").mapInArrow(_cells, "tk long, fp long, n long, tk2 long, fp2 long, n2 long")


def _possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities differ in no more places than similar sets of their sizes may."""
    for batch in slices(batches):
        differ = differing(batch.column(5).to_pylist(), batch.column(6).to_pylist())
        yield batch.filter(pa.array(9 * differ <= batch.column(4).to_numpy())).select(["x", "y", "a", "b"])


def _verify(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True)
            yield batch.filter(pa.array([similar(shingle_set(x, shingle), shingle_set(y, shingle)) for x, y in pairs], pa.bool_())).select(["a", "b"])

    return run


def _fits(n: Column, m: Column) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _enough(n: Column, m: Column, shared: Column) -> Column:
    """Whether prefixes of sets of these sizes share as many shingles as those of similar sets.

    Similar sets have 4 (n + m) / 9 shingles in common, and of these no more lie behind either
    prefix than the larger rest has, since both sets are in one order.
    """
    rest = F.greatest(F.ceil(4 * n / 5), F.ceil(4 * m / 5)) - 1
    return 9 * (shared + rest) >= 4 * (n + m)


def linked(edges: DataFrame, marks: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``edges`` (a, b), components of fingerprints, after linking those of similar texts."""
    own = stored(marks.filter("n > 0").select("tk", "_id", "_th", "fp", "n", "bits", "least").dropDuplicates(["tk"]), "texts")
    # Shingles travel with their text's hash alone until those of one text only have gone.
    tokens = marks.filter("n > 0").select("tk", "prefix").dropDuplicates(["tk"]).select("tk", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token")
    members = stored(tokens.hint("merge").join(shared, "token").hint("merge").join(own.select("tk", "fp", "n"), "tk"), "prefixes")
    turn, rows_before = 0, None
    while True:
        roots = edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        rows = members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        open_ = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
        members, before = stored(rows.join(open_, "token").select("token", "tk", "fp", "n", "root"), "open"), members
        forget(before)
        sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
        size = sizes.agg(F.sum("k").alias("texts"), F.sum(F.col("k").cast("double") * (F.col("k") - 1) / 2).alias("pairs")).first()
        if not size.texts:
            return edges
        last = size.pairs <= DENSE * size.texts or (rows_before is not None and size.texts > rows_before - rows_before // FOLDS)
        rows_before = size.texts
        by = ["tk", "fp", "n", "tk2", "fp2", "n2"]
        if last:  # here a pair meets in all shingles that both prefixes hold
            near = close_pairs(members, sizes, own).groupBy(by).agg(F.count(F.lit(1)).alias("shared")).filter(_enough(F.col("n"), F.col("n2"), F.col("shared")))
        else:  # the same text leads in most of the shingles that it is in
            lead = F.struct(F.xxhash64("tk", F.lit(turn)).alias("h"), *[F.col(c).alias(f"{c}2") for c in ("tk", "fp", "n", "root")])
            other = members.groupBy("token").agg(F.min(lead).alias("x")).select("token", "x.tk2", "x.fp2", "x.n2", "x.root2")
            near = members.hint("merge").join(other, "token").filter(F.col("root") != F.col("root2")).filter(_fits(F.col("n"), F.col("n2")))
            most = near.groupBy(by).agg(F.count(F.lit(1)).alias("shared")).groupBy("tk", "fp", "n").agg(F.max(F.struct("shared", "tk2", "fp2", "n2")).alias("x"))
            near = most.select("tk", "fp", "n", "x.tk2", "x.fp2", "x.n2")
        pairs = near.select(F.least("tk", "tk2").alias("x"), F.greatest("tk", "tk2").alias("y"), F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"), (F.col("n") + F.col("n2")).alias("n")).distinct()
        bits = lambda key, name: own.select(F.col("tk").alias(key), F.col("bits").alias(name))
        rows = pairs.hint("merge").join(bits("x", "s"), "x").hint("merge").join(bits("y", "t"), "y").select("x", "y", "a", "b", "n", "s", "t")
        pairs = stored(rows.mapInArrow(_possible, "x long, y long, a long, b long"), "pairs")
        needed = pairs.select(F.explode(F.array("x", "y")).alias("tk")).distinct()
        wanted = stored(own.select("tk", "_id", "_th").hint("merge").join(needed, "tk"), "wanted")
        words = stored(texts.select("_id", "_th", "text").join(wanted, ["_id", "_th"]).select("tk", "text").dropDuplicates(["tk"]), "words")
        both = pairs.hint("merge").join(words.select(F.col("tk").alias("x"), F.col("text").alias("s")), "x").hint("merge").join(words.select(F.col("tk").alias("y"), F.col("text").alias("t")), "y")
        found = both.select("a", "b", "s", "t").mapInArrow(_verify(shingle), "a long, b long")
        edges, before = simhash.connected(edges.unionByName(found.distinct())), edges
        forget(before, pairs, wanted, words)
        if last:
            forget(members, own)
            return edges
        root_free = members.drop("root")
        root_free.stored_at = members.stored_at
        members = root_free
        turn += 1
