"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are read in overlapping chunks that cover all of it. Each byte has a learned
embedding and one more channel, how often its word has just been repeated (0 to 1). Learned
filters slide over every position of a chunk; the largest response of each filter over the
whole document goes through one hidden layer into a probability. Training follows the
gradient through each document's maxima; it takes place on the driver, on a bounded sample of
labelled documents (``SampleSize``), whole texts. Documents are scored inside Spark tasks.

Defined cases: null and empty texts are scored as a text with no filter response; without
labels of both kinds every score is 0.5; rows with equal or null doc_id are each scored (null
ids are not learned from; of rows that share an id and a label the sample has the least
text); long texts are scored chunk by chunk to their end; of equal responses the first counts;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import in_fold, slices, table, utf8
from trawl.llm.op5_rules import labelled

CHUNK = 1 << 15
OVERLAP = 1 << 10  # half of it holds a filter's width and the words that may be repeated
WIDTH = 8
EMBED = 7
FILTERS = 16
HIDDEN = 8
SCORES = "doc_id long, score double"
_MIX = np.random.default_rng(3).integers(1, 1 << 62, 64, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class SampleSize:
    """Bounds of the training sample; texts of over ``chars`` are scored but not learned from."""

    per_label: int = 500
    chars: int = 50_000
    epochs: int = 12
    batch: int = 32


def repeats(raw: np.ndarray) -> np.ndarray:
    """For each byte, how often its word equals the words just before, up to 4, over 4."""
    space = _SPACE[raw]
    word = ~space
    out = np.zeros(len(raw), np.float32)
    begins = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    if len(begins) < 2:
        return out
    ends = np.flatnonzero(word & np.concatenate([space[1:], [True]])) + 1
    sizes = ends - begins
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mixed = (raw[word].astype(np.uint64) + np.uint64(1)) * _MIX[within & 63]
    codes = np.add.reduceat(mixed, np.cumsum(sizes) - sizes)
    same = np.concatenate([[False], (codes[1:] == codes[:-1]) & (sizes[1:] == sizes[:-1])])
    at = np.arange(len(same))
    run = np.minimum(at - np.maximum.accumulate(np.where(same, -1, at)), 4)
    out[word] = np.repeat((run / 4).astype(np.float32), sizes)
    return out


class ByteCNN:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
        self.params = {
            "E": rng.standard_normal((256, EMBED)).astype(np.float32) * np.float32(0.5),
            "F": draw(WIDTH * (EMBED + 1), FILTERS), "f": np.zeros(FILTERS, np.float32),
            "H": draw(FILTERS, HIDDEN), "h": np.zeros(HIDDEN, np.float32),
            "O": draw(HIDDEN, 1), "o": np.zeros(1, np.float32),
        }

    def channels(self, raw: np.ndarray) -> np.ndarray:
        """Embedded bytes (n, EMBED + 1), with silence of half a filter on both ends."""
        out = np.zeros((len(raw) + WIDTH, EMBED + 1), np.float32)
        mid = out[WIDTH // 2 : WIDTH // 2 + len(raw)]
        mid[:, :EMBED] = self.params["E"][raw]
        mid[:, EMBED] = repeats(raw)
        return out

    def responses(self, raw: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter at places ``first`` to ``last`` of a chunk, and
        where its input begins."""
        c = self.channels(raw)
        n = len(raw) + 1
        step = c.strides[0]
        seen = np.lib.stride_tricks.as_strided(c, (n, WIDTH * (EMBED + 1)), (step, c.strides[1]))
        r = seen[first:last] @ self.params["F"]
        at = r.argmax(axis=0)
        return r[at, np.arange(FILTERS)] + self.params["f"], at + first

    def pooled(self, text: bytes) -> np.ndarray:
        """Largest responses over the whole text, chunk by chunk (at least 0)."""
        best = np.zeros(FILTERS, np.float32)
        raw = np.frombuffer(text, np.uint8)
        for at in range(0, max(1, len(raw) - OVERLAP), CHUNK - OVERLAP):
            if len(part := raw[at : at + CHUNK]):
                # Each chunk answers for the places up to the middle of what it shares with the
                # next one, so none sees silence, or a cut word, within the text.
                last = None if at + CHUNK >= len(raw) else CHUNK - OVERLAP // 2
                np.maximum(best, self.responses(part, OVERLAP // 2 if at else 0, last)[0], out=best)
        return best

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.params["H"] + self.params["h"], 0)
        return hidden, 1 / (1 + np.exp(-(hidden @ self.params["O"] + self.params["o"])[:, 0].astype(np.float64)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.head(np.stack([self.pooled(t) for t in texts]))[1]

    def gradients(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.params
        found = [self.responses(t) if len(t) else (np.zeros(FILTERS, np.float32), None) for t in texts]
        pooled = np.maximum(np.stack([f[0] for f in found]), 0)
        hidden, prob = self.head(pooled)
        loss = float(-(weight * np.log(np.where(y > 0, prob, 1 - prob) + 1e-9)).sum() / weight.sum())
        d = (weight * (prob - y) / weight.sum()).astype(np.float32)[:, None]
        grads = {"O": hidden.T @ d, "o": d.sum(axis=0)}
        dh = (d @ p["O"].T) * (hidden > 0)
        grads |= {"H": pooled.T @ dh, "h": dh.sum(axis=0)}
        dp = (dh @ p["H"].T) * (pooled > 0)
        grads |= {"F": np.zeros_like(p["F"]), "f": dp.sum(axis=0), "E": np.zeros_like(p["E"])}
        filters = p["F"].reshape(WIDTH, EMBED + 1, FILTERS)
        for text, (_, at), dr in zip(texts, found, dp, strict=True):
            if at is None or not dr.any():
                continue
            c = self.channels(text)
            for j in np.flatnonzero(dr):
                b = at[j]
                grads["F"][:, j] += dr[j] * c[b : b + WIDTH].reshape(-1)
                first = b - WIDTH // 2
                own = np.arange(max(0, first), min(len(text), first + WIDTH))
                np.add.at(grads["E"], text[own], dr[j] * filters[own - first, :EMBED, j])
        return loss, grads

    def train(self, texts: list[bytes], y: np.ndarray, size: SampleSize, rate: float = 0.01, seed: int = 9) -> float:
        """Adam over shuffled batches, both labels with equal weight; the last epoch's loss."""
        rng = np.random.default_rng(seed)
        raws = [np.frombuffer(t, np.uint8) for t in texts]
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        i, losses = 0, []
        for epoch in range(size.epochs):
            losses = []
            order = rng.permutation(len(y))
            for at in range(0, len(order), size.batch):
                own = order[at : at + size.batch]
                loss, grads = self.gradients([raws[k] for k in own], y[own], weight[own])
                losses.append(loss)
                i += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.params[k] -= (rate * (1 - 0.8 * epoch / size.epochs) * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses))


def train_quality(docs: DataFrame, labels: DataFrame, size: SampleSize = SampleSize()) -> ByteCNN | None:
    """Learns from ``labels`` (doc_id, quality): documents of each label, chosen by hash."""
    chosen = labelled(docs, labels, size.per_label)
    rows = chosen.select("quality", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= size.chars).collect()
    rows.sort(key=lambda r: (r.quality, r.text))
    y = np.array([r.quality for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    model = ByteCNN()
    model.train([r.text.encode() for r in rows], y, size)
    return model


def _scorer(model: ByteCNN | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in utf8(batch.column(1))]
            score = model.score(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scorer(model), SCORES)


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    model = train_quality(docs, labels.filter(~held_out))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
