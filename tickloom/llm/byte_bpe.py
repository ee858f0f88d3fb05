"""Byte-level BPE encoding and decoding by corpus-level merge replay (op 13)."""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.blocks import PIECE, gather
from tickloom.llm.common import table
from tickloom.llm.shingles import texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text of a block, words whose merges are replayed at once, and words that a worker remembers.
BLOCK, WORDS, KNOWN = 8 << 20, 1 << 17, 600_000
_LOADED: dict = {}


class Vocabulary:
    """The ranks of a file: ``ids`` by bytes, the bytes of all ids end to end, and the ranks of pairs of single bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        n = max(self.ids.values()) + 1
        self.tokens = [b""] * n
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])])
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.pairs = np.array([[self.ids.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)


def vocabulary(path: str | None) -> Vocabulary:
    """Each Python worker reads a file once. Without a path, the public file's own place on the executor."""
    if path not in _LOADED:
        import public_tokenizers
        _LOADED[path] = Vocabulary(path or public_tokenizers.path(VOCABULARY))
    return _LOADED[path]


def splitter(pattern: str | None = None) -> re.Pattern:
    """The pattern with its Unicode classes written out, as the plain expression engine has none: letters, numbers, white space."""
    if ("pattern", pattern) not in _LOADED:
        import public_tokenizers
        letters, numbers = _class("L"), _class("N")
        space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        out, inside = [], False
        for x in re.findall(r"\\p\{[LN]\}|\\[sS]|\\.|.", pattern or public_tokenizers.PATTERN):
            inside = (inside or x == "[") and x != "]"
            body = {"\\p{L}": letters, "\\p{N}": numbers, "\\s": space}.get(x)
            out.append(f"[^{space}]" if x == "\\S" and not inside else x if body is None else body if inside else f"[{body}]")
        _LOADED["pattern", pattern] = re.compile("".join(out))
    return _LOADED["pattern", pattern]


def _class(kind: str) -> str:
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def words_of(text: str, pattern: re.Pattern) -> Iterator[list[str]]:
    """The matches of a whole text, some at a time. A part ends before a space that follows a letter or a digit and comes before
    another one: matches never run over such a place."""
    lo = 0
    while len(text) - lo > 2 * PIECE:
        edge = _EDGE.search(text, lo + PIECE)
        if edge is None:
            break
        yield pattern.findall(text, lo, edge.start() + 1)
        lo = edge.start() + 1
    yield pattern.findall(text, lo)


_EDGE = re.compile(r"[a-z0-9](?= [a-z0-9])")


def replay(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, bounds): every merge is applied to all words before the next one, in order of rank.

    An index leads from each pair of neighbours that is a token to the places where it stands. The lowest rank is taken from a
    heap, its places are joined from left to right, and only the pairs with the two neighbours of a joined place change in the
    index; places that no longer hold the pair are passed over. If joining makes a pair of a lower rank, the rest of that word
    waits until it has been joined, as it would in the word alone. A word that is a token is that token, whatever the merges say.
    """
    out: list = [v.ids.get(w) for w in words]
    rest = [i for i, x in enumerate(out) if x is None]
    data = np.frombuffer(b"".join(words[i] for i in rest), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(words[i]) for i in rest], dtype=np.int64)])
    n = len(data)
    ids = array("i", v.single[data].astype(np.int32).tobytes())
    ahead, behind = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = starts[:-1][np.diff(starts) > 0]
    behind[filled] = -1
    ahead[starts[1:][np.diff(starts) > 0] - 1] = -1
    rank = np.full(n, -1)
    if n > 1:
        rank[:-1] = np.where(ahead[:-1] >= 0, v.pairs[data[:-1], data[1:]], -1)
    at = np.flatnonzero(rank >= 0)
    at = at[np.argsort(rank[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(rank[at])) + 1
    index = {int(rank[g[0]]): g.tolist() for g in np.split(at, cuts) if len(g)}
    heap = list(index)
    heapify(heap)
    ahead, behind, rank = (array("i", x.astype(np.int32).tobytes()) for x in (ahead, behind, rank))
    ends = starts.tolist()
    token, find = v.tokens, v.ids.get

    while heap:
        r = heappop(heap)
        places = index.pop(r)
        places.sort()
        joined, stop, wait = token[r], -1, []
        for i in places:
            if rank[i] != r:
                continue
            if i < stop:
                wait.append(i)
                continue
            j = ahead[i]
            k, h, lowest = ahead[j], behind[i], r + 1
            ids[i], ids[j], ahead[i], rank[j] = r, -1, k, -1
            if k >= 0:
                behind[k] = i
                q = rank[i] = find(joined + token[ids[k]], -1)
                if q >= 0:
                    lowest = q
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heappush(heap, q)
            else:
                rank[i] = -1
            if h >= 0:
                q = rank[h] = find(token[ids[h]] + joined, -1)
                if q >= 0:
                    lowest = min(lowest, q)
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heappush(heap, q)
            if lowest < r:
                stop = ends[bisect_right(ends, i)]
        if wait:
            index[r] = wait
            heappush(heap, r)
    ids = np.frombuffer(ids, np.int32).astype(np.int64)
    live = ids >= 0
    seen = np.concatenate([[0], np.cumsum(live)])
    made, bounds = ids[live], seen[starts]
    sizes = np.ones(len(words), np.int64)
    sizes[rest] = np.diff(bounds)
    all_bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.array([-1 if x is None else x for x in out], np.int64)[np.repeat(np.arange(len(words)), sizes)]
    flat[flat < 0] = made
    return flat, all_bounds


def take(values: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists at ``at`` end to end, their bounds)."""
    n = np.diff(bounds)[at]
    out = np.concatenate([[0], np.cumsum(n)])
    return values[np.arange(out[-1]) - np.repeat(out[:-1], n) + np.repeat(bounds[at], n)], out


class Dictionary:
    """Words numbered as they come, and the ids of those that have been encoded: ``flat`` between ``bounds``."""

    def __init__(self, path: str | None):
        self.path, self.number = path, None

    def start(self) -> dict[str, int]:
        """The numbers to extend; what a task that failed has left half done, and what has grown too large, is forgotten."""
        if self.number is None or len(self.number) != len(self.bounds) - 1 or len(self.number) > KNOWN:
            self.number, self.flat, self.bounds = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        return self.number

    def encoded(self) -> tuple[np.ndarray, np.ndarray]:
        new = [w.encode() for w in islice(self.number, len(self.bounds) - 1, None)]
        for i in range(0, len(new), WORDS):
            flat, bounds = replay(new[i:i + WORDS], vocabulary(self.path))
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        return self.flat, self.bounds


def dictionary(path: str | None, pattern: str | None) -> Dictionary:
    if ("words", path, pattern) not in _LOADED:
        _LOADED["words", path, pattern] = Dictionary(path)
    return _LOADED["words", path, pattern]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ids (array of int), as the public library encodes without special tokens.

    Every task takes its part of the corpus in blocks of some megabytes: the matches of ``pattern`` in all texts of a block
    become numbers in a dictionary, merges are replayed over all its new words at once (WORDS at a time), and the numbers become
    ids. A worker keeps its dictionary for the blocks to come until it has more than KNOWN words, so memory is bounded. Nothing
    is shuffled or stored, so a lost task costs its own part alone.

    Null and empty texts have no ids; rows without an id and repeated rows pass as they are; an empty table gives no rows; other
    columns are ignored. A word of any length is one entry of the dictionary, a text longer than a block a block of its own.
    """
    rows = texts_of(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = dictionary(path, pattern), splitter(pattern)
        for _, block in gather(batches, "t", BLOCK):
            number, sequence, sizes = known.start(), [np.zeros(0, np.int64)], [0]
            for t in block["t"].to_pylist():
                before = len(sequence)
                sequence += [np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words)) for words in words_of(t, split)]
                sizes.append(sum(map(len, sequence[before:])))
            ids, ends = take(*known.encoded(), np.concatenate(sequence))
            at = ends[np.cumsum(sizes)]
            keys = block["k"].combine_chunks()
            for i in range(0, len(keys), 1000):
                few = at[i:i + 1001]
                yield pa.record_batch([keys.slice(i, 1000), pa.ListArray.from_arrays(pa.array(few - few[0], pa.int32()), pa.array(ids[few[0]:few[-1]], pa.int32()))], ["k", "ids"])

    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns and ``data``: the bytes of the ids (null stays null). An id that the vocabulary lacks is an error."""
    schema = encoded.select("*").withColumn("data", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                data = [None if x is None else take(v.data, v.bounds, np.asarray(x, np.int64))[0].tobytes() for x in (s.values.to_numpy() if s.is_valid else None for s in c[ids])]
                yield pa.record_batch([*c.columns, pa.array(data, pa.binary())], [*c.schema.names, "data"])

    return encoded.mapInArrow(run, schema)


def digest(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_tokens, and SHA-256 of ids and of decoded bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b[key], pa.array([len(s) for s in b["ids"]], pa.int64()), pa.array([sha256(s.values.to_numpy().astype("<u4").tobytes()).hexdigest() for s in b["ids"]]),
                                   pa.array([sha256(s.as_py()).hexdigest() for s in b["data"]])], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return decoded.mapInArrow(run, f"{key} {dict(decoded.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decode(encode(table(spark, sf_dir, "documents"))))
