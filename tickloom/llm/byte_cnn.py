"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text (op 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import remainder, table
from tickloom.llm.shingles import slices

#: Bytes of half a chunk (chunks overlap by half), width and step of the filters in bytes.
HALF, WIDTH, STEP = 256, 8, 2
DIM, FILTERS = 6, 24
#: Byte value of what lies beyond a text's end: its embedding is zero.
PAD = 256


def halves(text: bytes) -> np.ndarray:
    """A text as rows of half a chunk each, with the bytes a filter reads beyond it: (n + 1, HALF + WIDTH), n >= 1."""
    n = max(1, -(-len(text) // HALF))
    flat = np.full((n + 1) * HALF + WIDTH, PAD, np.int16)
    flat[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n + 1, HALF + WIDTH), (2 * HALF, 2))


class Net:
    """embedding -> filters -> ReLU -> maximum of each chunk -> maximum and mean over the chunks -> logistic unit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.5, (257, DIM)), "W": r.normal(0, 0.25, (WIDTH * DIM, FILTERS)), "b": np.zeros(FILTERS),
                  "v": r.normal(0, 0.3, 2 * FILTERS), "c": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.p["E"][PAD] = 0

    def windows(self, rows: np.ndarray) -> np.ndarray:
        e = self.p["E"][rows]                                               # (n, HALF + WIDTH, DIM)
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(rows), HALF // STEP, WIDTH * DIM), (s[0], STEP * s[1], s[2])).reshape(-1, WIDTH * DIM)

    def half_maxima(self, rows: np.ndarray) -> np.ndarray:
        """The filters' largest answers in each half chunk."""
        out = np.empty((len(rows), FILTERS), np.float32)
        for lo in range(0, len(rows), 32):                                   # stays in the processor's cache
            part = rows[lo:lo + 32]
            out[lo:lo + 32] = (self.windows(part) @ self.p["W"]).reshape(len(part), HALF // STEP, FILTERS).max(1)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each text from all of its bytes."""
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            h = self.half_maxima(halves(t))
            h = np.maximum(np.maximum(h[:-1], h[1:]) + self.p["b"], 0)
            out[i] = np.concatenate([h.max(0), h.mean(0)]) @ self.p["v"] + self.p["c"][0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 6, batch: int = 32, rate: float = 0.004, seed: int = 7, most_halves: int = 200) -> Net:
        """Adam on the cross entropy. Of texts over ``most_halves`` half chunks, that many evenly spaced over the whole text train."""
        r, y = np.random.default_rng(seed), np.asarray(labels, np.float32)
        cut = []
        for t in texts:
            h = halves(t)
            if len(h) > most_halves:
                at = np.linspace(0, len(h) - 2, most_halves // 2).astype(int)
                h = h[np.unique(np.concatenate([at, at + 1]))]
            cut.append(np.ascontiguousarray(h))
        m, q, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), batch):
                grad = {k: np.zeros_like(x) for k, x in self.p.items()}
                mine = order[lo:lo + batch]
                for i in mine:
                    self._backward(cut[i], y[i], grad)
                step += 1
                now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for k, g in grad.items():
                    g = g / len(mine)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    q[k] = 0.999 * q[k] + 0.001 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(q[k] / (1 - 0.999 ** step)) + 1e-8)
                self.p["E"][PAD] = 0
        return self

    def _backward(self, rows: np.ndarray, y: float, grad: dict[str, np.ndarray]) -> None:
        n, per = len(rows), HALF // STEP
        x = self.windows(rows)
        a = (x @ self.p["W"]).reshape(n, per, FILTERS)
        where = a.argmax(1)                                                  # (n, FILTERS)
        h = np.take_along_axis(a, where[:, None], 1)[:, 0]
        left = h[:-1] >= h[1:]
        pooled = np.where(left, h[:-1], h[1:]) + self.p["b"]
        act = np.maximum(pooled, 0)
        best = act.argmax(0)
        z = np.concatenate([act[best, np.arange(FILTERS)], act.mean(0)])
        d = 1 / (1 + np.exp(-np.clip(z @ self.p["v"] + self.p["c"][0], -30, 30))) - y
        grad["v"] += d * z
        grad["c"] += d
        g = np.tile(d * self.p["v"][FILTERS:] / len(act), (len(act), 1))
        g[best, np.arange(FILTERS)] += d * self.p["v"][:FILTERS]
        g *= pooled > 0
        grad["b"] += g.sum(0)
        chunk, f = np.nonzero(g)
        half = chunk + ~left[chunk, f]
        at = half * per + where[half, f]
        gv = g[chunk, f]
        xs = x[at]
        np.add.at(grad["W"].T, f, gv[:, None] * xs)
        ge = (gv[:, None] * self.p["W"].T[f]).reshape(-1, DIM)
        cols = (where[half, f] * STEP)[:, None] + np.arange(WIDTH)
        np.add.at(grad["E"], rows[half[:, None], cols].ravel(), ge)


def train(docs: DataFrame, labels: DataFrame, rows: int = 3000, folds: int = 5, key: str = "doc_id", text: str = "text", label: str = "quality") -> Net | None:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, chosen by the hash of their id; None without any.

    The sample's bound is the parameter ``rows``; ids are chosen before their texts are fetched. Labels serve only here.
    """
    marked = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(F.col(key), folds) != 0))
              .groupBy(key).agg(F.max(label).cast("int").alias("_y")).orderBy(F.xxhash64(key), key).limit(rows))
    found = (docs.where(remainder(F.col(key), folds) != 0).select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
             .join(F.broadcast(marked), key).groupBy(key, "_y").agg(F.min("_t").alias("_t")).orderBy(key).collect())
    if len({r["_y"] for r in found}) < 2:
        return None
    return Net().fit([r["_t"].encode("utf-8", "surrogatepass") for r in found], [r["_y"] for r in found])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, keep: bool = False, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: key, held_out, score (probability of quality), predicted; ``keep``: the input's columns and ``score``.

    Every byte of a text is read by the filters, in chunks of 512 bytes that overlap by half. Null texts are empty, and an empty
    text gets the score of one chunk without bytes; repeated rows score alike, each once; an empty table gives no rows. Without
    labels of both kinds every score is 0.5. The model, about 50 kB, goes to the tasks with the function.
    """
    net = train(docs, labels, folds=folds, key=key, text=text, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, read):
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in b[read].to_pylist()]
                s = net.scores(texts) if net else np.full(len(texts), 0.5)
                yield pa.record_batch([*(b[c] for c in b.schema.names if c != "_text"), pa.array(s, pa.float64())], [*(c for c in b.schema.names if c != "_text"), "_score"])

    cols = [c for c in docs.columns if not keep or c != "score"] if keep else [key]
    # a text that passes anyway is read from its own column: it goes to Python once
    read = text if text in cols and dict(docs.dtypes)[text] == "string" else "_text"
    rows = docs.select(*[F.col(c) for c in cols], *([] if read == text else [F.col(text).cast("string").alias("_text")]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    scored = rows.mapInArrow(score, f"{kinds}, _score double")
    if keep:
        return scored.withColumnRenamed("_score", "score")
    return scored.select(key, (remainder(F.col(key), folds) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
