"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows. One gated recurrent layer reads a window forwards,
another backwards; every position gets a probability for each language from both states, and
a document's probabilities are the mean over its positions. The network is trained in numpy
by backpropagation through time on windows of a bounded sample of labelled documents
(``SampleSize``), on the driver; documents are scored inside Spark tasks, all of their bytes.

Defined cases: null text, and text without a letter, is ``und`` with score 0; without any
labelled text nothing can be learned and every prediction is ``und`` with score 0; rows with
equal or null doc_id are each scored (null ids are not learned from); an empty table gives no
rows; a long text's windows are scored a few thousand at a time and its mean is over all of
them; of equal probabilities the language that sorts first is taken; extra columns of any
name are ignored, or kept by ``keep_recognised``. Of rows that share an id and a language
the sample has one text, the least.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import in_fold, one_text, sample_ids, slices, table, utf8

WINDOW = 64
HIDDEN = 8
PAD = 256
LANES = 4096
UNKNOWN = "und"


@dataclass(frozen=True)
class SampleSize:
    """Bounds of the training sample: documents of a language (about) and windows of one."""

    documents: int = 400
    windows: int = 8
    steps: int = 400
    batch: int = 256


@dataclass
class BiGRU:
    """Gates z and r use a hard sigmoid, clip(x / 4 + 1/2, 0, 1)."""

    languages: list[str]
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> "BiGRU":
        rng, h, k = np.random.default_rng(seed), hidden, len(languages)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
        params = {"V": draw(k, 2 * h), "c": np.zeros((k, 1), np.float32)}
        for d in "fb":
            params |= {f"W{d}": 2 * draw(3 * h, PAD + 1), f"U{d}": draw(3 * h, h), f"b{d}": np.zeros((3 * h, 1), np.float32)}
        for d in "fb":
            params[f"W{d}"] *= np.sqrt((PAD + 1) / (3 * h)).astype(np.float32)
        return cls(languages, params)

    def _states(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, H, N) of one direction over bytes x (T, N), and what training needs."""
        p, h = self.params, self.params["Uf"].shape[1]
        w, u = p[f"W{d}"] + p[f"b{d}"], p[f"U{d}"]
        if not keep:  # the gates' slope and offset go into the weights
            scale = np.where(np.arange(3 * h) < 2 * h, 0.25, 1).astype(np.float32)[:, None]
            w, u = w * scale + np.float32(0.5) * (scale < 1), u * scale
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        state, out, saved = np.zeros((h, x.shape[1]), np.float32), np.empty((len(x), h, x.shape[1]), np.float32), []
        for t in steps:
            gx = np.take(w, x[t], axis=1)
            gh = u @ state
            a = gx[: 2 * h]
            a += gh[: 2 * h]
            if keep:
                a *= 0.25
                a += 0.5
            gate = np.clip(a, 0, 1) if keep else np.clip(a, 0, 1, out=a)
            n = gx[2 * h :]
            n += gate[h:] * gh[2 * h :]
            n = np.tanh(n, out=None if keep else n)
            new = state - n
            new *= gate[:h]
            new += n
            if keep:
                saved.append((t, state, a, gate, n, gh[2 * h :]))
            state = out[t] = new
        return out, saved

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Sum over the positions of windows x (T, N) of each language's probability: (K, N)."""
        forward, backward = self._states(x, "f", False)[0], self._states(x, "b", False)[0]
        h, total = forward.shape[1], np.zeros((len(self.languages), x.shape[1]), np.float32)
        v1, v2, c = self.params["V"][:, :h], self.params["V"][:, h:], self.params["c"]
        for t in range(len(x)):
            s = v1 @ forward[t]
            s += v2 @ backward[t]
            s += c
            s -= s.max(axis=0)
            np.exp(s, out=s)
            s /= s.sum(axis=0)
            s *= x[t] != PAD
            total += s
        return total

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions, and its gradients through time."""
        p, h = self.params, self.params["Uf"].shape[1]
        states, saved = {}, {}
        for d in "fb":
            states[d], saved[d] = self._states(x, d, True)
        both = np.concatenate([states["f"], states["b"]], axis=1)  # (T, 2H, N)
        s = np.matmul(p["V"], both) + p["c"]
        s -= s.max(axis=1, keepdims=True)
        q = np.exp(s)
        q /= q.sum(axis=1, keepdims=True)
        live = (x != PAD).astype(np.float32)
        weight = live / max(1.0, live.sum())
        lanes = np.arange(x.shape[1])
        loss = float(-(np.log(q[:, y, lanes] + 1e-9) * weight).sum())
        q[:, y, lanes] -= 1
        q *= weight[:, None, :]
        grads = {"V": np.einsum("tkn,thn->kh", q, both, optimize=True), "c": q.sum(axis=(0, 2))[:, None]}
        dboth = np.matmul(p["V"].T, q)
        for k, d in enumerate("fb"):
            dh_all, u = dboth[:, k * h : (k + 1) * h], p[f"U{d}"]
            du, dpre = np.zeros_like(u), np.empty((len(x), 3 * h, x.shape[1]), np.float32)
            carry = np.zeros_like(dh_all[0])
            for t, before, a, gate, n, ghn in reversed(saved[d]):
                dh = dh_all[t] + carry
                z, r = gate[:h], gate[h:]
                dn = dh * (1 - z) * (1 - n * n)
                dgate = np.concatenate([dh * (before - n), dn * ghn])
                dgate *= 0.25 * ((a > 0) & (a < 1))
                dpre[t, : 2 * h], dpre[t, 2 * h :] = dgate, dn
                dgh = np.concatenate([dgate, dn * r])
                du += dgh @ before.T
                carry = dh * z + u.T @ dgh
            flat, at = dpre.transpose(0, 2, 1).reshape(-1, 3 * h), x.reshape(-1)
            dw = np.zeros((PAD + 1, 3 * h), np.float32)
            np.add.at(dw, at, flat)
            grads |= {f"U{d}": du, f"W{d}": dw.T, f"b{d}": flat.sum(axis=0)[:, None]}
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float = 0.02, seed: int = 11) -> float:
        """Adam with clipped gradients over shuffled batches; returns the last loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        loss = float("nan")
        for i in range(1, steps + 1):
            rows = rng.integers(0, len(x), min(batch, len(x)))
            loss, grads = self.gradients(np.ascontiguousarray(x[rows].T), y[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step = rate * (1 - 0.9 * i / steps)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.params[k] -= (step * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return loss


def windows_of(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts (W, size), padded, and each text's first window."""
    counts = np.array([-(-len(t) // size) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.full(int(first[-1]) * size, PAD, np.uint16)
    for t, at in zip(texts, first[:-1].tolist(), strict=True):
        flat[at * size : at * size + len(t)] = np.frombuffer(t, np.uint8)
    return flat.reshape(-1, size), first


def predict(model: BiGRU, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The best language's index and its mean probability, for texts that are not empty."""
    x, first = windows_of(texts)
    total = np.concatenate([np.zeros((len(model.languages), 0), np.float32), *[model.probabilities(np.ascontiguousarray(x[at : at + LANES].T)) for at in range(0, len(x), LANES)]], axis=1)
    sums = np.add.reduceat(total, first[:-1], axis=1) if len(texts) else total
    mean = sums / np.array([len(t) for t in texts], np.float32)
    return mean.argmax(axis=0), np.clip(mean.max(axis=0), 0, 1) if len(texts) else np.zeros(0)


def _sampler(windows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                last = max(0, len(text) - WINDOW)
                for at in sorted({round(last * i / max(1, windows - 1)) for i in range(windows)}):
                    langs.append(lang)
                    parts.append(text[at : at + WINDOW])
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "part": pa.array(parts, pa.binary())})

    return run


def train_languages(docs: DataFrame, size: SampleSize = SampleSize()) -> BiGRU | None:
    """Learns from ``docs`` (doc_id, text, lang): documents of each language, chosen by hash."""
    chosen = one_text(docs, sample_ids(docs, "lang", size.documents), "lang").filter(F.col("text").rlike("\\p{L}"))
    rows = chosen.select("lang", "text").mapInArrow(_sampler(size.windows), "lang string, part binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.part)))
    languages = sorted({r.lang for r in rows})
    x = windows_of([bytes(r.part) or b" " for r in rows])[0]
    by = {lang: np.array([i for i, r in enumerate(rows) if r.lang == lang]) for lang in languages}
    most = max(map(len, by.values()))
    even = np.concatenate([np.resize(i, most) for i in by.values()])  # each language as often
    model = BiGRU.fresh(languages)
    model.train(x[even], np.repeat(np.arange(len(languages)), most), size.steps, size.batch)
    return model


def _scorer(model: BiGRU | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, letters = utf8(batch.column(0).field("text")), batch.column(1).to_pylist()
            rows = [i for i, ok in enumerate(letters) if ok] if model else []
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if rows:
                best, score[rows] = predict(model, [texts[r] for r in rows])
                for r, b in zip(rows, best, strict=True):
                    lang[r] = model.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def score_languages(docs: DataFrame, model: BiGRU | None) -> DataFrame:
    """Each document as a struct ``row`` with lang_pred and score, from its whole text only."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter"))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scorer(model), schema)


def keep_recognised(docs: DataFrame, least: float = 0.3, size: SampleSize = SampleSize()) -> DataFrame:
    """``docs`` whose language is told with a mean probability of at least ``least``."""
    model = train_languages(docs.select("doc_id", "text", "lang").filter(~in_fold(F.col("doc_id"), 4, 2)), size)
    return score_languages(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = train_languages(docs.select("doc_id", "text", "lang").filter(~held_out))
    found = score_languages(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
