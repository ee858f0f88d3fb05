"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment (op 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stored, table
from tickloom.llm.shingles import bitmap, distinct_sets, in_bitmap, mix, shingle_hashes, slices, texts_of, word_hashes

#: Hash functions, shingles in a tile of the smallest size class, size classes (the last takes all larger items), bitmap bits.
FUNCTIONS, TILE, CLASSES, BITS = 64, 32, 12, 26
#: Items of fewer shingles are looked for by shingles themselves; their class.
SHORT, EXACT = 16, -1
_R = np.random.default_rng(8)
_A = _R.integers(0, 1 << 31, FUNCTIONS, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _R.integers(0, 1 << 32, FUNCTIONS, np.uint32)


def size_class(n: int) -> int:
    """Items of up to TILE * 2 ** c shingles are searched in windows of that many shingles."""
    c = 0
    while c < CLASSES - 1 and TILE << c < n:
        c += 1
    return c


def keys_of(minima: np.ndarray, cls: int) -> np.ndarray:
    """One 64-bit key for each minimum, its function and its size class; minima has a row for each function."""
    f = np.arange(FUNCTIONS, dtype=np.uint64)[:, None]
    return mix(minima.astype(np.uint64) | ((f + np.uint64(FUNCTIONS * cls)) << np.uint64(32)))


def window_keys(values: np.ndarray, bounds: np.ndarray, classes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index of each window, keys: functions x windows) for each size class, over whole texts.

    Minima of larger windows are minima of minima, so each shingle is hashed once whatever the number of classes.
    """
    n = np.diff(bounds)
    tiles = -(-n // TILE)
    doc = np.repeat(np.arange(len(n)), tiles)
    if not len(doc):
        return
    first = np.cumsum(tiles) - tiles
    starts = bounds[doc] + (np.arange(len(doc)) - first[doc]) * TILE
    x = (values >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((FUNCTIONS, len(starts)), np.uint32)
    for f in range(FUNCTIONS):
        np.minimum.reduceat(x * _A[f] + _B[f], starts, out=minima[f])
    for c in range(max(classes) + 1):
        if c:
            pairs = -(-tiles // 2)
            first, doc = np.cumsum(tiles) - tiles, np.repeat(np.arange(len(n)), pairs)
            at = first[doc] + 2 * (np.arange(len(doc)) - (np.cumsum(pairs) - pairs)[doc])
            minima, tiles = np.minimum.reduceat(minima, at, axis=1), pairs
        if c in classes:
            yield doc, keys_of(minima, c)


def shingle_keys(values: np.ndarray) -> np.ndarray:
    """Keys of shingles themselves, apart from those of minima."""
    return mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A))


def index_items(items: DataFrame, key: str, text: str, width: int, least: float) -> DataFrame:
    """(k, cls, keys, shingles) of every test item that has words. A text that holds ``least`` of an item's q shingles holds one of
    any that are more than it may lack: so many are the keys of a short item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in slices(b, "t"):
                v, at = distinct_sets(*shingle_hashes(*word_hashes(c["t"]), width))
                rows = []
                for i, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
                    if hi > lo:
                        q = int(hi - lo)
                        if q < SHORT:
                            need = max(1, next(n for n in range(q + 1) if n / q >= least or n == q))
                            rows.append((i, EXACT, shingle_keys(v[lo:hi][:q - need + 1]).view(np.int64), v[lo:hi].view(np.int64)))
                            continue
                        cls = size_class(q)
                        x = (v[lo:hi] >> np.uint64(32)).astype(np.uint32)
                        low = (x[None] * _A[:, None] + _B[:, None]).min(1, keepdims=True)
                        rows.append((i, cls, keys_of(low, cls)[:, 0].view(np.int64), v[lo:hi].view(np.int64)))
                if rows:
                    i, cls, keys, sets = zip(*rows)
                    yield pa.record_batch([c["k"].take(pa.array(i)), pa.array(cls, pa.int32()), pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(sets), pa.list_(pa.int64()))], ["k", "cls", "keys", "shingles"])

    rows = texts_of(items, key, text)
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, cls int, keys array<bigint>, shingles array<bigint>")


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) with at least ``least`` of the item's shingles in the document: key, item_key, n_shared,
    n_item, containment.

    Items are partitioned by size. A document is cut into windows of each size in use, and an item meets the windows of its own
    size, so that a short item weighs enough against the text around it; any equal minimum among 64 makes a candidate. An item
    of q >= 16 shingles that lie in one window of w <= 2 q then goes unseen with probability below 1e-9; more often when cut by a
    window border or scattered over many windows. Items below 16 shingles weigh too little in a window: some of their shingles
    themselves are looked for, and none goes unseen. Candidates are decided on the whole document's shingles.

    Windows are never shuffled: a task tests its windows' keys against a bitmap of 8 MB, whatever the number of items, and sends
    on only documents that hit a bit, with those of their distinct shingles that a second such bitmap finds among the items'.
    The joins that follow are exact, so a full bitmap costs time, not results. Texts of fewer than ``width`` words are one shingle, and match only a text that is equal to it in words.

    Null and empty texts and items have no shingles and match nothing; equal rows match alike and are reported once (a null id
    too); empty tables give no rows; further columns of the input are ignored.
    """
    index = stored(index_items(items, item_key, item_text, width, least), "test-items")
    classes = sorted(r["cls"] for r in index.select("cls").distinct().collect())        # at most CLASSES
    short, classes = EXACT in classes, [c for c in classes if c != EXACT]
    postings = index.select(F.col("k").alias("item"), F.explode("keys").alias("h"))
    context = docs.sparkSession.sparkContext
    wanted = context.broadcast(bitmap(postings, "h", BITS))
    asked_for = context.broadcast(bitmap(index.select(F.explode("shingles").alias("h")), "h", BITS))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for b in batches:
            for c in slices(b, "t", 2 << 20):
                v, at = shingle_hashes(*word_hashes(c["t"]), width)
                hits: dict[int, set] = {}
                for doc, keys in window_keys(v, at, classes) if classes else ():
                    for f, w in zip(*np.nonzero(in_bitmap(bits, keys))):
                        hits.setdefault(int(doc[w]), set()).add(int(keys[f, w].view(np.int64)))
                if short:
                    own = shingle_keys(v)
                    for j in np.flatnonzero(in_bitmap(bits, own)):
                        hits.setdefault(int(np.searchsorted(at, j, "right")) - 1, set()).add(int(own[j].view(np.int64)))
                if hits:
                    at_docs = sorted(hits)
                    sets = [np.unique(v[at[i]:at[i + 1]]) for i in at_docs]
                    names = [hashlib.md5(s.tobytes()).hexdigest() for s in sets]
                    sets = [s[in_bitmap(asked_for.value, s)].tobytes() for s in sets]
                    yield pa.record_batch([c["k"].take(pa.array(at_docs)), pa.array(names),
                                           pa.array([sorted(hits[i]) for i in at_docs], pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["k", "d", "keys", "shingles"])

    rows = texts_of(docs, key, text)
    kind, item_kind = dict(rows.dtypes)["k"], dict(index.dtypes)["k"]
    hit = stored(rows.mapInArrow(search, f"k {kind}, d string, keys array<bigint>, shingles binary"), "test-hits")
    pairs = hit.select("k", "d", F.explode("keys").alias("h")).join(postings, "h").select("k", "d", "item").distinct()
    sets = hit.select("k", "d", F.col("shingles").alias("own"))
    same = [F.col("a.k").eqNullSafe(F.col("b.k")), F.col("a.d") == F.col("b.d")]
    full = pairs.alias("a").join(sets.alias("b"), same).select("a.k", "item", "own")
    full = full.join(index.select(F.col("k").alias("item2"), F.col("shingles").alias("asked")), F.col("item").eqNullSafe(F.col("item2"))).select("k", "item", "own", "asked")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, asked = (b[x].to_pylist() for x in ("own", "asked"))
            shared = [int(np.isin(np.array(q, np.int64), np.frombuffer(d, np.int64), assume_unique=True).sum()) for d, q in zip(own, asked)]
            yield pa.record_batch([b["k"], b["item"], pa.array(shared, pa.int64()), pa.array([len(q) for q in asked], pa.int64())], ["k", "item", "n_shared", "n_item"])

    share = F.col("n_shared") / F.col("n_item")
    return (full.mapInArrow(verify, f"k {kind}, item {item_kind}, n_shared long, n_item long").where(share >= least).distinct()
            .select(F.col("k").alias(key), F.col("item").alias(item_key), "n_shared", "n_item", share.alias("containment")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
