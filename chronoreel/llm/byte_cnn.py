"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over the whole UTF-8 text. Blocks of ``HALF`` bytes are max-pooled, two
neighbouring blocks make a chunk, so chunks overlap by half. The mean and the maximum over a document's
chunks, with two figures of its length, pass one hidden layer to one probability.

Training takes a bounded sample of labelled rows to the driver: of the labelled documents, in the order of a
hash, at most ``max_rows`` and ``max_bytes`` of whole texts, half from each label as far as there are so many;
the loss is weighted back to the labels' shares. A filter's gradient touches one window per chunk, the one
that won the pooling. Training and scoring take a text in pieces of bounded size, so that a long one costs
time but not memory.

Defined cases: a null text counts as empty and gets the score of the empty text; labels other than 0 and 1,
null labels and labels without a document are ignored; of texts that share an id the longest counts; without rows of both labels every score is the
share of label 1 (0.5 without labels); repeated rows and null ids are scored row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import dropped, fold, stored, text_or_empty

WIDTH = 6
FILTERS = 32
HIDDEN = 16
HALF = 256
PAD = 256
PIECE = 512  # blocks convolved at once


def as_codes(text: bytes) -> np.ndarray:
    """Byte codes padded to whole blocks, with room for the last window."""
    size = max(HALF, -(-(len(text) + WIDTH - 1) // HALF) * HALF)
    out = np.full(size, PAD, np.int32)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def length_figures(texts: list[bytes]) -> np.ndarray:
    """How full the first chunk is, and the logarithm of the length."""
    n = np.array([len(t) for t in texts], np.float32)
    return np.stack([np.minimum(1, n / (2 * HALF)), np.log1p(n) / 10], axis=1).astype(np.float32)


@dataclass
class ByteCNN:
    seed: int = 5
    prior: float | None = None
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        features = 2 * FILTERS + 2
        self.w = {
            "conv": rng.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "hid": rng.normal(0, features**-0.5, (features, HIDDEN)).astype(np.float32),
            "hid_bias": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.w["conv"][:, PAD] = 0

    def _head(self, pooled: np.ndarray, fill: np.ndarray) -> np.ndarray:
        x = np.concatenate([pooled, fill], axis=1)
        return np.tanh(x @ self.w["hid"] + self.w["hid_bias"]) @ self.w["out"] + self.w["out_bias"][0]

    # Training -----------------------------------------------------------------

    def fit(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, visits: int = 12_000, batch: int = 16, rate: float = 0.01) -> None:
        rng = np.random.default_rng(self.seed)
        codes = [as_codes(t).astype(np.int16) for t in texts]
        fill = length_figures(texts)
        steps = max(1, visits // batch)
        order = np.concatenate([rng.permutation(len(texts)) for _ in range(-(-steps * batch // len(texts)))])
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            rows = order[(step - 1) * batch : step * batch]
            grads = self._gradients([codes[i] for i in rows], fill[rows], labels[rows].astype(np.float32), weights[rows].astype(np.float32))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-7)
            self.w["conv"][:, PAD] = 0

    def _gradients(self, codes: list[np.ndarray], fill: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        wins, pooled, kept = [], [], []
        for x in codes:
            value, place = self._winners(x)
            if len(value) > 1:  # chunks of two blocks
                second = value[1:] > value[:-1]
                value, place = np.where(second, value[1:], value[:-1]), np.where(second, place[1:], place[:-1])
            best = value.argmax(axis=0)
            pooled.append(np.concatenate([value.mean(axis=0), value.max(axis=0)]))
            wins.append(place)
            kept.append((value > 0, best))
        p, w = np.array(pooled), self.w
        x = np.concatenate([p, fill], axis=1)
        h = np.tanh(x @ w["hid"] + w["hid_bias"])
        d = (1 / (1 + np.exp(-(h @ w["out"] + w["out_bias"][0]))) - y) * weight / len(y)
        dh = d[:, None] * w["out"] * (1 - h * h)
        dx = dh @ w["hid"].T
        g = {"out": h.T @ d, "out_bias": np.array([d.sum()], np.float32), "hid": x.T @ dh, "hid_bias": dh.sum(axis=0)}
        conv, bias, cols = np.zeros_like(w["conv"]), np.zeros_like(w["bias"]), np.arange(FILTERS)
        for i, code in enumerate(codes):
            positive, best = kept[i]
            dv = np.tile(dx[i, :FILTERS] / len(positive), (len(positive), 1))
            dv[best, cols] += dx[i, FILTERS : 2 * FILTERS]
            dv *= positive
            bias += dv.sum(axis=0)
            for k in range(WIDTH):
                np.add.at(conv[k], (code[np.minimum(wins[i] + k, len(code) - 1)], cols[None]), dv)
        return g | {"conv": conv, "bias": bias}

    def _winners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block and filter, the largest response (ReLU; windows that would leave the text give 0) and its place."""
        values, places = [], []
        for at in range(0, len(x), PIECE * HALF):
            part = x[at : at + PIECE * HALF + WIDTH - 1]
            size = min(PIECE * HALF, len(x) - at)
            z = np.zeros((size, FILTERS), np.float32)
            n = len(part) - WIDTH + 1
            for k in range(WIDTH):
                z[:n] += self.w["conv"][k][part[k : k + n]]
            z[:n] += self.w["bias"]
            z = np.maximum(z, 0, out=z).reshape(-1, HALF, FILTERS)
            top = z.argmax(axis=1)
            values.append(np.take_along_axis(z, top[:, None], axis=1)[:, 0])
            places.append(top + at + np.arange(len(z))[:, None] * HALF)
        return np.concatenate(values), np.concatenate(places)

    # Scoring ------------------------------------------------------------------

    def pair_tables(self) -> list[np.ndarray]:
        """For each two neighbouring filter positions, the sums of their rows by byte pair."""
        conv = self.w["conv"]
        return [(conv[k][:, None] + conv[k + 1][None]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]

    def block_maxima(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """The pooled filters of each block of a padded text."""
        out = []
        for at in range(0, len(x), PIECE * HALF):
            part = x[at : at + PIECE * HALF + WIDTH - 1]
            n = min(PIECE * HALF, len(x) - at)
            full = len(part) - WIDTH + 1
            pairs = part[:-1] * (PAD + 1) + part[1:]
            z = np.zeros((n, FILTERS), np.float32)
            for k, t in enumerate(tables):
                z[:full] += t[pairs[2 * k : 2 * k + full]]
            z[:full] += self.w["bias"]
            out.append(np.maximum(z, 0, out=z).reshape(-1, HALF, FILTERS).max(axis=1))
        return np.concatenate(out)

    def scores(self, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        pooled = np.empty((len(texts), 2 * FILTERS), np.float32)
        for i, t in enumerate(texts):
            b = self.block_maxima(as_codes(t), tables)
            chunks = np.maximum(b[1:], b[:-1]) if len(b) > 1 else b
            pooled[i, :FILTERS], pooled[i, FILTERS:] = chunks.mean(axis=0), chunks.max(axis=0)
        fill = length_figures(texts)
        return 1 / (1 + np.exp(-self._head(pooled, fill).astype(np.float64)))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, max_rows: int = 4000, max_bytes: int = 32 << 20, visits: int = 16_000) -> ByteCNN:
    """A network fitted to at most ``max_rows`` labelled documents, ``max_bytes`` in all, outside the held-out fold.

    One task fits it, and its weights come back; the driver holds ids and sizes of the sample only.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", folds) != held)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    known = stored(known.join(texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")), "doc_id"), "labelled")
    share = known.agg(F.avg("quality").alias("p")).first()["p"]
    model = ByteCNN()
    ids: dict[int, int] = {}
    for q in (0, 1):
        left = max_bytes // 2
        # Ids and sizes only, max_rows in all; a text that would take too much is left to others.
        for r in known.where(F.col("quality") == q).orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id").limit(max_rows // 2).collect():
            if r["size"] <= left:
                ids[r["doc_id"]] = q
                left -= r["size"]
    dropped(known)
    if len(set(ids.values())) < 2:
        model.prior = 0.5 if share is None else float(share)
        return model
    chosen = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, quality int")
    # One text an id, so at most max_rows texts and max_bytes meet in the one task that fits the network.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.struct(F.octet_length("text").alias("n"), "text"))["text"].cast("binary").alias("text"), F.max("quality").alias("quality"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, t, q) for batch in batches for i, t, q in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if not found:
            return
        y = np.array([q for _, _, q in found])
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model.fit([t for _, t, _ in found], y, weight, visits)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.w)], pa.binary())], ["w"])

    model.w = pickle.loads(rows.repartition(1).mapInArrow(fit, "w binary").first()["w"])
    return model


def score(docs: DataFrame, model: ByteCNN, folds: int = 3, held: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.pair_tables()
        for batch in batches:
            found = model.scores([x.as_py() for x in batch.column(2)], tables)
            columns = [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held).alias("held_out"), text_or_empty("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """The rows of ``docs`` whose text scores 0.5 or more."""

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = model.pair_tables()
        for texts in batches:
            yield texts.map(lambda t: bool(model.scores([t], tables)[0] >= 0.5))

    return docs.where(good(text_or_empty("text").cast("binary")))
