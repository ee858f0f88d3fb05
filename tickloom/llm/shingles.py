"""Words and shingles of Arrow text columns as 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes hashed at a time, which bounds memory; a block is prolonged to the end of its last word.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]          # A-Z count as a-z
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, BLOCK + 4096), base, np.uint64)
        p[0] = 1
        _POWERS[base] = have = np.cumprod(p, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column without nulls."""
    a = texts.cast(pa.large_binary())
    bounds = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``limit`` bytes of text; a longer text is a piece of its own."""
    if batch.num_rows == 0:
        return
    _, bounds = buffers(batch[column])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; text i has those from bounds[i] to bounds[i + 1]."""
    data, bounds = buffers(texts)
    lo, stop = int(bounds[0]), int(bounds[-1])
    hashes, starts = [], []
    while lo < stop:
        hi = min(lo + BLOCK, stop)
        if hi < stop:
            edge = int(bounds[np.searchsorted(bounds, hi)])
            while hi < edge:
                blank = np.flatnonzero(_BLANK[data[hi:min(hi + 4096, edge)]])
                if len(blank):
                    hi += int(blank[0])
                    break
                hi = min(hi + 4096, edge)
        d = data[lo:hi]
        word = ~_BLANK[d]
        new = np.zeros(len(d) + 1, bool)
        inside = bounds[np.searchsorted(bounds, lo):np.searchsorted(bounds, hi, "right")] - lo
        new[inside] = True
        new[0] = new[-1] = True
        new[1:-1] |= ~word[:-1]
        first = np.flatnonzero(word & new[:-1])
        after = new[1:].copy()
        after[:-1] |= ~word[1:]
        last = np.flatnonzero(word & after) + 1
        total = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(_BYTE[d] * _powers(_INVERSE, len(d))[:len(d)], out=total[1:])
        hashes.append(mix((total[last] - total[first]) * _powers(_BASE, len(d))[first]))
        starts.append(first + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of all runs of ``width`` words in order; a shorter text that has words is one shingle."""
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(out_bounds[-1], np.uint64)
    if len(words) >= width:
        x = words[:len(words) - width + 1].copy()
        for j in range(1, width):
            x = mix(x) * np.uint64(_BASE) + words[j:len(words) - width + 1 + j]
        ok = np.repeat(n >= width, count)
        at = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], count) + np.repeat(bounds[:-1], count)
        out[ok] = mix(x[at[ok]])
    for i in np.flatnonzero((n > 0) & (n < width)):
        x = np.uint64(n[i])
        for w in words[bounds[i]:bounds[i + 1]]:
            x = mix(np.array([x]))[0] ^ w
        out[out_bounds[i]] = mix(np.array([x]))[0]
    return out, out_bounds


def distinct_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order."""
    parts, sizes = [], np.zeros(len(bounds), np.int64)
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        s = np.sort(values[lo:hi])
        if len(s):
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        parts.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(parts) if parts else values), np.cumsum(sizes)


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t): nothing but the id and the text, null texts empty."""
    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of fixed size, 2 ** bits bits, with the bits of all keys (longs) set: what may be broadcast in place of the keys
    themselves. Spark combines it in words of 64 bits; at most 2 ** (bits - 6) words reach the driver."""
    at = F.pmod(F.col(column), F.lit(1 << bits))
    words = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
