"""Mixture-controlled packing: deficit round-robin over source queues fills sequences in target proportions (op 4)."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stored, table

#: Queues at most; beyond that the smaller sources share hashed queues, so that the schedule has a proven size.
MAX_QUEUES = 1024
#: Words of a generation that a worker process remembers, across its tasks.
CACHE = 300_000
#: Fixed-point steps of one token of credit.
STEP = 1024


class Encoder(dict):
    """Token ids of texts by a public tokenizer: a mapping from words to their ids, filled as words are met, of bounded size.

    Words are kept in two generations of some CACHE each: what is met again moves to the younger one, and the older one goes
    when the younger is full. So frequent words stay, in workers that live on through other stages too, without filling them.

    Blanks and line ends always part tokens in a vocabulary that drops white space, so a text's ids are those of its
    blank-separated words in order. Plain words, Latin letters and then ASCII punctuation, are two pieces to the tokenizer; for
    them its model is asked directly, and once for each piece.
    """

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)").fullmatch

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok = Tokenizer.from_file(vocabulary)
        one = ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenize = self.tok.model.tokenize
        self.bytes = {c: one.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x100) if not chr(c).isspace()}
        self.code, self.kind = ("H", "<u2") if self.tok.get_vocab_size() <= 1 << 16 else ("I", "<u4")
        self.older, self.marks = {}, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            plain = self.PLAIN(word)
            if not plain:
                ids = array(self.code, self.tok.encode(word, add_special_tokens=False).ids).tobytes()
            elif word == plain[1].lower():
                ids = self.piece(word)
            else:                                   # the letters alone are a word, too
                ids = self[plain[1].lower()] + self.mark(plain[2])
        self[word] = ids
        return ids

    def mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > CACHE:
                self.marks.clear()
            self.marks[marks] = self.piece(marks)
        return self.marks[marks]

    def piece(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(piece.translate(self.bytes))]).tobytes()

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        last, out = array(self.code, [end]).tobytes(), []
        for t in texts:
            if len(self) > CACHE:
                self.older = dict(self)
                self.clear()
            out.append(b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))) + last)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker process's encoder: most words of a task are known from the tasks before."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encode(docs: DataFrame, key: str, text: str, source: str, vocabulary: str, end: int) -> DataFrame:
    """Each document's ids with its place among the documents of its source in the same task (part, before)."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, part, before = encoder(vocabulary), TaskContext.get().partitionId(), {}
        width = np.dtype(enc.kind).itemsize
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                c = b.slice(lo, 256)
                ids = enc.encode(c["t"].to_pylist(), end)
                at = []
                for s, x in zip(c["source"].to_pylist(), ids):
                    at.append(before.get(s, 0))
                    before[s] = at[-1] + len(x) // width
                yield pa.record_batch([c["k"], c["source"], pa.array([part] * c.num_rows, pa.int32()), pa.array(at, pa.int64()),
                                       pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * c.num_rows, pa.int32())],
                                      ["k", "source", "part", "before", "n", "ids", "width"])

    return rows.mapInArrow(run, f"k {kind}, source string, part int, before long, n long, ids binary, width int")


class Schedule:
    """Where each token of each queue goes, in closed form.

    Deficit round-robin: in every round a queue gets its share of ``size`` tokens of credit, serves as many whole portions of
    ``portion`` tokens as its credit covers, and carries what is left (its deficit) to the next round. Credit after round k is
    a product and no sum, so every task knows a queue's deficit at any window without having seen the windows before: deficits
    cross windows and partitions alike. An empty queue serves nothing. Rounds follow each other without a gap; every ``size``
    tokens are one sequence. What is left at the very end becomes sequences of powers of two, which need no padding.
    """

    def __init__(self, totals: np.ndarray, shares: np.ndarray, size: int, portion: int):
        self.totals, self.size, self.portion = totals.astype(np.int64), size, portion
        self.credit = np.maximum(1, (shares / max(shares.sum(), 1e-300) * size * STEP)).astype(np.int64)
        n = int(self.totals.sum())
        self.full = n // size
        rest, cuts = n % size, [self.full * size]
        while rest:
            cuts.append(cuts[-1] + (1 << (rest.bit_length() - 1)))
            rest -= cuts[-1] - cuts[-2]
        self.tail = np.array(cuts, np.int64)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue has served before the given rounds: one row per round."""
        return np.minimum(self.totals, rounds[:, None] * self.credit // (self.portion * STEP) * self.portion)

    def place(self, queue: np.ndarray, portion: np.ndarray) -> np.ndarray:
        """The rank in the packed stream of the first token of each (queue, portion)."""
        rounds = -(-(portion + 1) * self.portion * STEP // self.credit[queue]) - 1
        out = np.empty(len(queue), np.int64)
        some = max(1, 2_000_000 // max(1, len(self.totals)))
        distinct, at = np.unique(rounds, return_inverse=True)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(0, len(distinct) + some, some))
        for i, lo in enumerate(range(0, len(distinct), some)):
            mine = order[ends[i]:ends[i + 1]]
            done, then = self.served(distinct[lo:lo + some]), self.served(distinct[lo:lo + some] + 1)
            start = done.sum(1)[:, None] + np.cumsum(then - done, 1) - (then - done)
            r, q = at[mine] - lo, queue[mine]
            out[mine] = start[r, q] + portion[mine] * self.portion - done[r, q]
        return out

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray):
        """(document index, start in it, length, sequence, offset) of the documents' pieces; ``first``: place in its queue."""
        lo, hi = first // self.portion, (first + np.maximum(n, 1) - 1) // self.portion
        count = hi - lo + 1
        doc = np.repeat(np.arange(len(n)), count)
        p = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[doc]
        a = np.maximum(p * self.portion, first[doc])
        z = np.minimum((p + 1) * self.portion, (first + n)[doc])
        rank = self.place(queue[doc], p) + a - p * self.portion
        edge = self.full * self.size
        cut = np.minimum((rank // self.size + 1) * self.size, np.maximum(rank, edge))       # of the pieces in full sequences
        parts = [(doc, a, rank, np.minimum(z - a, np.where(rank < edge, cut - rank, 0)))]
        more = rank + (z - a) > np.where(rank < edge, cut, rank)
        d2, a2, r2, e2 = doc[more], (a + parts[0][3])[more], (rank + parts[0][3])[more], z[more]
        inner = r2 < edge       # portions are no longer than a sequence: the rest ends in the next one, or in the tail
        stop = np.where(inner, np.minimum(e2 - a2, edge - r2), 0)
        parts.append((d2, a2, r2, stop))
        d3, a3, r3, left = d2, a2 + stop, r2 + stop, e2 - a2 - stop
        for i in range(len(self.tail) - 1):
            take = np.where((r3 >= self.tail[i]) & (r3 < self.tail[i + 1]), np.minimum(left, self.tail[i + 1] - r3), 0)
            parts.append((d3, a3, r3, take))
            a3, r3, left = a3 + take, r3 + take, left - take
        doc, a, rank, length = (np.concatenate(x) for x in zip(*parts))
        keep = np.flatnonzero(length > 0)
        keep = keep[np.lexsort((a[keep], doc[keep]))]
        doc, a, rank, length = doc[keep], a[keep], rank[keep], length[keep]
        tail = np.searchsorted(self.tail, rank, "right") - 1
        seq = np.where(rank < edge, rank // self.size, self.full + tail)
        head = np.where(rank < edge, seq * self.size, self.tail[np.maximum(tail, 0)])
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (rank[1:] != rank[:-1] + length[:-1])
        at = np.flatnonzero(new)
        return doc[at], (a - first[doc])[at], np.add.reduceat(length, at) if len(at) else length, seq[at], (rank - head)[at]


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = 1, size: int = 2048, portion: int = 128, targets: dict[str, float] | None = None,
         key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece: key, source, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every sequence holds ``size`` tokens in the proportions of ``targets`` (source -> weight; by default the proportions of
    the corpus, which empties all queues together); a source is at most one portion behind its due. Documents are cut freely
    and no token is left out; only the last few sequences are shorter, each a power of two.

    Ids are computed once and kept in the shared folder with their place in the task's part of each queue; places in the whole
    queue follow from sums per (part, source), so no queue passes through one task. The driver sees one total per queue.

    Null texts are empty and hold the end id alone; null sources are one unnamed source; repeated rows are packed each; an
    empty table gives no rows; further columns of the input are ignored.
    """
    if portion > size or size & (size - 1):
        raise ValueError("size must be a power of two, and a portion no longer than it")
    rows = stored(encode(docs, key, text, source, vocabulary or vocabulary_path(), end), "packing-ids")
    sums = rows.groupBy("part", "source").agg(F.sum("n").alias("n"))
    sources = sums.groupBy("source").agg(F.sum("n").alias("n"))
    largest = [r["source"] for r in sources.orderBy(F.desc("n"), "source").limit(MAX_QUEUES).collect()]
    if len(largest) == MAX_QUEUES:      # more sources than queues may be: the smaller half of the queues is shared
        largest = largest[:MAX_QUEUES // 2]
        names = F.when(F.col("source").isin(largest), F.concat(F.lit("="), "source")).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(MAX_QUEUES // 2)).cast("string")))
    else:
        names = F.concat(F.lit("="), "source")
    sums = stored(sums.withColumn("queue", names), "packing-sums")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()}
    order = list(totals)
    weights = np.array([float(totals[q]) if targets is None else float(targets.get(q[1:], 0.0) if q[0] == "=" else 0.0) for q in order])
    plan = Schedule(np.array([totals[q] for q in order], np.int64), weights, size, portion)
    base = sums.select("part", "source", F.sum("n").over(Window.partitionBy("queue").orderBy("part", "source")).alias("upto"), "n",
                       F.array_position(F.array(*map(F.lit, order)) if order else F.array().cast("array<string>"), F.col("queue")).alias("q"))
    base = base.select("part", "source", (F.col("upto") - F.col("n")).alias("base"), (F.col("q") - 1).cast("int").alias("q"))
    placed = rows.join(base, ["part", "source"]).select("k", "source", "q", (F.col("base") + F.col("before")).alias("first"), "n", "ids", "width")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                c = b.slice(lo, 500)
                doc, start, length, seq, offset = plan.pieces(*(c[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("q", "first", "n")))
                width = c["width"].to_pylist()
                ids = [np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for x, w in zip(c["ids"].to_pylist(), width)]
                cuts = [ids[d][4 * s:4 * (s + m)] for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist())]
                yield pa.record_batch([c["k"].take(pa.array(doc)), c["source"].take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(cuts, pa.binary()),
                                       c["n"].take(pa.array(doc)), pa.array(seq), pa.array(offset)],
                                      ["k", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = dict(rows.dtypes)["k"]
    return placed.mapInArrow(cut, f"k {kind}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("k", key)


def digest(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
