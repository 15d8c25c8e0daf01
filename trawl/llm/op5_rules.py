"""Quality rules: document statistics, base rules, and boosted trees over the statistics.

Statistics are counted over whole texts in Spark tasks. Trees are grown in numpy on the
driver from a bounded sample of labelled documents (about ``PER_LABEL`` of each label), with
second-order gradient boosting on histograms; on the features of ``MONOTONE`` a split may
only lower the score as the feature grows, and bounds passed down keep it so in the whole
tree. The trees are flattened to node arrays and score all documents of a batch at once.

Defined cases: null and empty texts have all counts 0, fail the base rules and are not kept;
without labels of both kinds the trees keep every document; rows with equal or null doc_id
are each judged (null ids are not learned from; of rows that share an id and a label the
sample has the least text); texts of any length are counted whole; a score of just 0.5 keeps;
an empty table gives no rows; other columns of any name are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import one_text, sample_ids, slices, table, utf8

MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words
SPAN = 8
SYMBOLS = b"#*$%&|<>"
PER_LABEL = 2000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_chars", "symbols", "dup_lines", "repeated", "longest_run", "exclaims", "capitals", "stops", "digits", "distinct"]
#: Features of which more must never raise the score.
MONOTONE = frozenset({"symbols", "dup_lines", "repeated", "longest_run", "exclaims"})


def repeated_words(codes: np.ndarray, span: int = SPAN) -> int:
    """Words that lie in some window of ``span`` words found twice or more in the text."""
    n = len(codes) - span + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(span):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64) + np.uint64(1)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    at = np.flatnonzero(same)
    windows = np.lib.stride_tricks.sliding_window_view(codes, span)
    twice = np.zeros(n, bool)
    if (windows[order[at]] == windows[order[at + 1]]).all():
        twice[order[at]] = twice[order[at + 1]] = True
    else:  # two windows share a hash value
        seen: dict[bytes, int] = {}
        for i in range(n):
            j = seen.setdefault(windows[i].tobytes(), i)
            if j != i:
                twice[i] = twice[j] = True
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + span, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the values of ``FEATURES``."""
    text = text or b""
    words = text.split()  # bytes.split() knows exactly the six ASCII spaces
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, n)
    raw = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines, seen, repeated_lines = text.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            repeated_lines += 1
        elif line.strip():
            seen.add(line)
    again = repeated_words(codes)
    changes = np.flatnonzero(np.diff(codes))
    run = int(np.diff(np.concatenate([[-1], changes, [n - 1]])).max())
    count = lambda s: len(text) - len(text.translate(None, s))
    features = [np.log1p(n), chars / n, symbols / n, repeated_lines / len(lines), again / n, min(run, 50), text.count(b"!") / n, int(((raw >= 65) & (raw <= 90)).sum()) / n, count(b".,") / n, count(b"0123456789") / n, len(known) / n]
    return [n, chars, symbols, repeated_lines, again], features


@dataclass
class Trees:
    """Node arrays of all trees: a leaf points to itself, so every row takes equal steps."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that each row's label is 1."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 5) -> Trees:
    """Boosts trees for the log-loss of y; ``monotone[f]`` is -1 where f may not raise scores."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes: list[list] = []  # feature, cut, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def leaf(rows, low, high):
            value = -g[rows].sum() / (h[rows].sum() + ridge)  # noqa: B023
            return float(np.clip(value, low, high))

        def build(rows, level, low, high):
            me = len(nodes)
            nodes.append([0, np.inf, me, me, 0.0])
            own, best = leaf(rows, low, high), (1e-6, None)
            if level < depth:
                gs, hs = g[rows].sum(), h[rows].sum()  # noqa: B023
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]  # noqa: B023
                    hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]  # noqa: B023
                    nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                    # The loss change of both leaves at their clipped values.
                    gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + ridge) * vr**2) + (gs * own + 0.5 * (hs + ridge) * own**2)
                    fine = (nl >= least) & (len(rows) - nl >= least)
                    if monotone[f] < 0:
                        fine &= vl >= vr
                    gain = np.where(fine, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, vl[k], vr[k]))
            if best[1] is None:
                nodes[me][4] = rate * own
                margin[rows] += rate * own
                return me
            f, k, vl, vr = best[1]
            middle = (vl + vr) / 2
            side = binned[rows, f] <= k
            bounds = ((middle, high), (low, middle)) if monotone[f] < 0 else ((low, high), (low, high))
            left = build(rows[side], level + 1, *bounds[0])
            right = build(rows[~side], level + 1, *bounds[1])
            nodes[me] = [f, cuts[f][k], left, right, 0.0]
            return me

        roots.append(build(np.arange(len(y)), 0, -8.0, 8.0))
    columns = list(zip(*nodes, strict=True))
    return Trees(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4]), np.array(roots), base, depth)


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t)[1] for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["quality", "x"])


def labelled(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, quality, text) of about ``per_label`` documents of each label, by hash."""
    known = labels.filter("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sample_ids(known, "quality", per_label), "quality")


def train_rules(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Trees | None:
    chosen = labelled(docs, labels, per_label)
    rows = chosen.select("quality", "text").mapInArrow(_featured, "quality int, x array<double>").collect()
    rows.sort(key=lambda r: (r.quality, r.x))
    y = np.array([r.quality for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    return grow(np.array([r.x for r in rows]), y, [-1 if f in MONOTONE else 0 for f in FEATURES])


JUDGED = [*COUNTS, "base_failed", "kept", "score"]


def _judge(trees: Trees | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            measured = [measure(t) for t in utf8(batch.column(0).field("text"))]
            counts = np.array([m[0] for m in measured], np.int64).reshape(-1, len(COUNTS))
            features = np.array([m[1] for m in measured], float).reshape(-1, len(FEATURES))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])
            score = trees.score(features) if trees and len(features) else np.ones(len(features))
            columns = [*(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *JUDGED])

    return run


def judge(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Each document as a struct ``row`` with its counts, base_failed, kept and score."""
    kinds = [*[(c, T.LongType()) for c in COUNTS], ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(*k) for k in kinds)])
    return docs.select(F.struct("*").alias("row")).mapInArrow(_judge(trees), schema)


def keep_good(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    return judge(docs, train_rules(docs, labels, per_label)).filter("kept").select("row.*")


def op5_tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, train_rules(docs, table(spark, sf_dir, "labels")))
    return judged.select("row.doc_id", *COUNTS, "base_failed", "kept")
