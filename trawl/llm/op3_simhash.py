"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint holds, for each of 64 bits, whether the bit is set in over half of its
shingles' hashes. For radius r every bit position gets a vector of r + 1 bits, and each
non-zero vector v of r + 1 bits gives one mask: the positions whose vector has an odd
product with v. Any r positions leave a v that is orthogonal to all their vectors, so two
fingerprints at most r bits apart agree on at least one mask: none of the 2**(r+1) - 1 tables
is needed twice and no pair is missed.

Equal fingerprints are folded first, so a large group of copies is one row. Buckets are
solved to a spanning tree each, never to pairs. A bucket of over ``LIMIT`` fingerprints is
cut again by covering masks over the positions that its own mask leaves open; what then falls
together differs in so few positions that its size is bounded by their number. The trees'
edges go through alternating large and small stars until nothing changes.

Defined cases: null and empty texts have fingerprint zero and link to each other; fewer words
than a shingle form one shingle; a null doc_id takes part and never names a component unless
all its members are null; rows with equal doc_id are all returned; an empty table gives no
rows; a text of any length has all its shingles counted; of equal fingerprints one row stands
for all until the end; other columns are ignored, whatever their names. A component's root is
a key of many edges; adaptive execution splits such a partition of a merge join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import jaccard
from trawl.llm.common import forget, keyed, slices, small_batches, stored, table, utf8

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
LIMIT = 2048


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes for each shingle of a text, repeated ones as often as they occur."""
    # bytes.lower() and bytes.split() know exactly A-Z and the six ASCII spaces.
    words = (text or b"").lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-shingle]])
    return b"".join([digest(joined[b:e], seed) for b, e in zip(begins.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)])


def majority(hashes: bytes) -> int:
    """The bits that are set in over half of the hashes."""
    raw = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 65536):
        counts += np.unpackbits(raw[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def _fingerprints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in utf8(batch.column(3))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], names=["doc_id", "_id", "_th", "fp"])

    return run


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the given positions: any ``radius`` of them are all absent from some mask.

    Vectors are dealt to positions in turn, so masks have nearly equal weight.
    """
    size = 1 << (radius + 1)
    vector = {p: 1 + i % (size - 1) for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(masks: list[int], fp: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(t).cast("short").alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))


def spanning_edges(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, smallest of its component) over links of at most ``radius`` bits."""
    rest = np.unique(members.view(np.uint64))
    edges = []
    while len(rest) > 1:
        root, rest, todo = rest[0], rest[1:], [rest[0]]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= radius
            if near.any():
                new = rest[near]
                rest = rest[~near]
                todo.extend(new)
                edges.extend((int(x.view(np.int64)), int(root.view(np.int64))) for x in new)
    return edges


def _solve(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            edges = [e for b, n in zip(offsets[:-1], offsets[1:], strict=True) for e in spanning_edges(values[b:n], radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def bucket_edges(fps: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct ``fps`` (fp)."""
    masks = covering_masks(list(range(BITS)), radius)

    def shared(rows: DataFrame, on: list[str]) -> DataFrame:
        # Spark takes these rows to be as large as the fingerprints that they were made from, of
        # which each gives a row for each mask: without the hint it would broadcast them.
        sizes = rows.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return rows.hint("merge").join(sizes, on)

    def solved(rows: DataFrame, on: list[str]) -> DataFrame:
        return rows.groupBy(on).agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_solve(radius), "a long, b long")

    rows = fps.select("fp", _tables(masks, F.col("fp")).alias("x")).select("fp", "x.t", "x.key")
    members = stored(shared(rows, ["t", "key"]), "buckets")
    edges = solved(members.filter(F.col("n") <= limit), ["t", "key"])
    large = members.filter(F.col("n") > limit)
    if large.limit(1).count():
        for t, mask in enumerate(masks):
            finer = covering_masks([p for p in range(BITS) if not mask >> p & 1], radius)
            own = large.filter(F.col("t") == t).select("fp", "key", _tables(finer, F.col("fp")).alias("x")).select("fp", "key", F.col("x.t").alias("t2"), F.col("x.key").alias("key2"))
            on = ["key", "t2", "key2"]
            edges = edges.unionByName(solved(shared(own, on), on))
    edges = edges.distinct()
    edges.drawn_from = members
    return edges


def connected(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not its component's smallest, and that smallest node."""
    source = getattr(edges, "drawn_from", None)
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    if source is not None:
        forget(source)  # the buckets have been solved
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            return edges
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.hint("merge").join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, last = stored(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges"), edges
        forget(last)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, limit: int = LIMIT, similar: bool = False) -> DataFrame:
    """A row per document: doc_id, _id, _th, fp (as a signed long) and component_id.

    With ``similar``, texts whose shingle sets have a Jaccard similarity of 0.8 or more are
    linked too, whatever their fingerprints.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    texts = rows.select("row.doc_id", "_id", "_th", "row.text")
    found = jaccard.marked(texts, shingle) if similar else texts.mapInArrow(_fingerprints(shingle), "doc_id long, _id long, _th long, fp long")
    with small_batches(docs.sparkSession):
        fps = stored(found, "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = connected(bucket_edges(classes.select("fp"), radius, limit))
    if similar:
        whole, edges = fps, jaccard.linked(edges, fps, texts, shingle)
        fps = stored(fps.select("doc_id", "_id", "_th", "fp"), "fingerprints")
        forget(whole)
    links = edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = classes.join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = stored(rooted.join(roots, "root").select("fp", "component_id", "root"), "components")
    return fps.join(names, "fp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row of smallest doc_id stays (of
    several with that id the one of least text hash, of rows with one text any one: the first
    in order of their other columns)."""
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("_id"), F.col("_th")))
    keep = stored(found.groupBy("root").agg(first.alias("x")).select("x._id", "x._th"), "kept")
    rows = keyed(docs).join(keep, ["_id", "_th"])
    if rows.select("_id", "_th").groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        rows = rows.groupBy("_id", "_th").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
