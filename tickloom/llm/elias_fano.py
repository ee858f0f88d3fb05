"""Elias-Fano sequences and the n-gram trie built of them: flat images that are mapped, not parsed."""

from __future__ import annotations

import mmap
import struct

import numpy as np

class Monotone:
    """A rising sequence of integers in about 2 + log2(universe / n) bits each: low bits packed, high bits in unary.

    ``get`` reads by position, ``find`` searches by value (successor search inside the run of equal high bits); both work on
    whole arrays. Counts of ones before each 64 bits are the only directory.
    """

    def __init__(self, image):
        buf = memoryview(image)
        self.n, self.low, words, low_bytes = struct.unpack_from("<QQQQ", buf)
        self.upper = np.frombuffer(buf, np.uint64, words, 32)
        self.before = np.frombuffer(buf, np.int64, words + 1, 32 + words * 8)
        self.lows = np.ndarray((low_bytes - 7,), "<u8", buf, 40 + words * 16, (1,))     # the 8 bytes at every place
        self.zeros = np.arange(words + 1, dtype=np.int64) * 64 - self.before

    @staticmethod
    def image(values: np.ndarray, universe: int) -> bytes:
        """The flat image of ascending values below ``universe``."""
        n, v = len(values), values.astype(np.uint64)
        low = max(0, int(universe // max(n, 1)).bit_length() - 1)
        high = (v >> np.uint64(low)).astype(np.int64)
        words = (n + (int(universe) >> low) + 1) // 64 + 1
        bits = np.zeros(words * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        upper = np.packbits(bits, bitorder="little")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(upper.view(np.uint64)), dtype=np.int64)])
        packed = []
        for at in range(0, n if low else 0, 1 << 17):               # 2 ** 17 values fill whole bytes
            part = ((v[at:at + (1 << 17), None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed.append(np.packbits(part.ravel(), bitorder="little").tobytes())
        lows = b"".join(packed) + bytes(16)
        lows += bytes(-len(lows) % 8)
        return struct.pack("<QQQQ", n, low, words, len(lows)) + upper.tobytes() + before.tobytes() + lows

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        bit = i * self.low
        return ((self.lows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero, of the unary part."""
        start = self.before if ones else self.zeros
        word = np.searchsorted(start, k, "right") - 1
        bits, left, place = self.upper[word], k - start[word], word << 6
        if not ones:
            bits = ~bits
        for size in (32, 16, 8, 4, 2, 1):       # halve the word towards the bit
            below = np.bitwise_count(bits & np.uint64((1 << size) - 1)).astype(np.int64)
            right = left >= below
            left -= below * right
            place += size * right
            bits >>= np.uint64(size) * right.astype(np.uint64)
        return place

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i) << self.low) | self._low(i)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Position of each value; -1 where the sequence does not hold it."""
        out = np.full(len(value), -1, np.int64)
        if not self.n or not len(value):
            return out
        high = value >> self.low
        live = np.flatnonzero(high < (self.zeros[-1] - 1))
        h = high[live]
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        hi = self._select(h, False) - h
        want, end = value[live] & ((1 << self.low) - 1), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):                       # by halves: values may crowd under one high part
            mid = (lo[open_] + hi[open_]) >> 1
            below = self._low(mid) < want[open_]
            lo[open_[below]], hi[open_[~below]] = mid[below] + 1, mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        near = np.flatnonzero(lo < end)
        near = near[self._low(lo[near]) == want[near]]
        out[live[near]] = lo[near]
        return out


#: Steps of one unit of log10 in a quantised probability: 16 bits reach 32 units.
UNIT = 2048


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs * UNIT), 0, 65535).astype("<u2")


class Trie:
    """Trigram model over one shard: context word v -> word w, and v -> word before u -> w relative to v.

    Levels: pairs (v, w) and contexts (v, u) as monotone sequences, pointers from v to its successors, and below each context
    its successors, each written as its rank among the successors of v ("context-relative"), which keeps the numbers small.
    A query first searches the successor in the shorter context; its rank there is what the longer context is searched for.
    Smoothing is interpolated Kneser-Ney with one discount; what is stored is the finished log10 probability, quantised.
    """

    PARTS = ("pairs", "contexts", "pointers", "bases", "triples", "pair_logs", "triple_logs", "v_backoff", "context_backoff")

    def __init__(self, image):
        buf = memoryview(image)
        sizes = struct.unpack_from(f"<{len(self.PARTS) + 1}Q", buf)
        self.words, at = sizes[0], 8 * (len(self.PARTS) + 1)
        for name, size in zip(self.PARTS, sizes[1:]):
            part = buf[at:at + size]
            setattr(self, name, Monotone(part) if name in self.PARTS[:5] else np.frombuffer(part, "<u2"))
            at += size + (-size % 8)

    @classmethod
    def open(cls, path: str) -> Trie:
        """Map an image from a file."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def mapped(cls, image: bytes) -> Trie:
        """Map an image held in pages of its own, outside the interpreter's heap."""
        pages = mmap.mmap(-1, max(1, len(image)))
        pages.write(image)
        return cls(pages)

    @classmethod
    def image(cls, v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, base: np.ndarray, n_v: int, words: int, discount: float, spread: tuple[np.ndarray, ...] | None = None) -> bytes:
        """The image of a model of distinct trigrams (u, v, w) with counts; ``base``: unigram probability of each word. ``spread``:
        (v, w, before, mass, degree) of all pairs of context words that other shards hold trigrams of too; their counts are these."""
        context = v * words + u
        if len(v) and ((context[1:] < context[:-1]) | ((context[1:] == context[:-1]) & (w[1:] < w[:-1]))).any():
            order = np.lexsort((w, context))
            v, w, context, count = v[order], w[order], context[order], count[order]
        first = np.concatenate([[True], context[1:] != context[:-1]])[:len(v)]
        ctx = np.cumsum(first) - 1
        contexts, ctx_v = context[first], v[first]
        own, whole = v * words + w, np.zeros(0, np.int64) if spread is None else spread[0] * words + spread[1]
        pairs = np.unique(np.concatenate([own, whole]))
        pair = np.searchsorted(pairs, own)
        pair_v, pair_w = pairs // words, pairs % words
        held = np.bincount(pair_v, minlength=n_v)
        before = np.bincount(pair, minlength=len(pairs)).astype(float)            # different words before the pair
        mass, degree = np.bincount(pair_v, before, n_v), held.copy()
        if spread is not None:
            before[np.searchsorted(pairs, whole)] = spread[2]
            mass[spread[0]], degree[spread[0]] = spread[3], spread[4]
        back_v = np.where(mass > 0, discount * degree / np.maximum(mass, 1), 1.0)
        p2 = np.maximum(before - discount, 0) / mass[pair_v] + back_v[pair_v] * base[pair_w]
        total = np.bincount(ctx, count, len(contexts))
        kinds = np.bincount(ctx, minlength=len(contexts))
        back_c = discount * kinds / np.maximum(total, 1)
        p3 = np.maximum(count - discount, 0) / total[ctx] + back_c[ctx] * p2[pair]
        pointer = np.concatenate([[0], np.cumsum(held)])
        reach = np.concatenate([[0], np.cumsum(held[ctx_v])]).astype(np.int64)
        triples = reach[ctx] + pair - pointer[v]
        parts = [Monotone.image(pairs, n_v * words), Monotone.image(contexts, n_v * words), Monotone.image(pointer, len(pairs) + 1),
                 Monotone.image(reach[:-1], int(reach[-1]) + 1), Monotone.image(triples, int(reach[-1]) + 1),
                 quantised(np.log10(p2)).tobytes(), quantised(np.log10(p3)).tobytes(), quantised(np.log10(back_v)).tobytes(), quantised(np.log10(back_c)).tobytes()]
        head = struct.pack(f"<{len(parts) + 1}Q", words, *map(len, parts))
        return head + b"".join(p + bytes(-len(p) % 8) for p in parts)

    def query(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, base_log: np.ndarray) -> np.ndarray:
        """log10 P(w | u, v) of distinct or repeated trigrams; ``base_log``: log10 unigram probability of each w."""
        pair = self.pairs.find(v * self.words + w)
        seen = pair >= 0
        p = np.where(seen, 0.0, base_log - self.v_backoff[v] / UNIT)
        p[seen] = self.pair_logs[pair[seen]] / -UNIT
        context = self.contexts.find(v * self.words + u)
        known = np.flatnonzero(context >= 0)
        both = known[seen[known]]
        rank = pair[both] - self.pointers.get(v[both])
        triple = self.triples.find(self.bases.get(context[both]) + rank)
        p[known] -= self.context_backoff[context[known]] / UNIT
        hit = triple >= 0
        p[both[hit]] = self.triple_logs[triple[hit]] / -UNIT
        return p
