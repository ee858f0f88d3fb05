"""Importance resampling towards a target distribution: array-scored weights and a distributed quickselect (op 11)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.blocks import PIECE
from tickloom.llm.common import stored, table
from tickloom.llm.shingles import slices, texts_of

#: Words in UTF-8 after lower-casing A-Z: digits, letters a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Random pivots of a round.
PIVOTS = 31
KEY = ["key_score", "no_id", "k", "n_features", "weight"]


class Buckets(dict):
    """Feature -> bucket; forgets all when it has grown large."""

    def __init__(self, buckets: int, most: int = 500_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[feature] = b = crc32(feature) % self.buckets
        return b


def word_runs(text: bytes, grams: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) of a text piece by piece: all runs of 1 to ``grams`` consecutive words, also across pieces."""
    lo, tail = 0, []
    while lo < len(text):
        hi = min(lo + PIECE, len(text))
        while hi < len(text) and WORD.match(text, hi, hi + 1) or b"A" <= text[hi:hi + 1] <= b"Z":
            hi += 1
        words = WORD.findall(text[lo:hi].lower())
        runs, both = list(words), tail + words
        for g in range(2, grams + 1):
            start = max(0, len(tail) - g + 1)
            runs += [b" ".join(both[i:i + g]) for i in range(start, len(both) - g + 1)]
        yield len(words), runs
        tail = both[len(both) - min(len(both), grams - 1):]
        lo = hi


def bucket_counts(docs: DataFrame, grams: int, buckets: int, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket: one array a task, summed by Spark; ``buckets`` rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), Buckets(buckets)
        for b in batches:
            for c in slices(b, "t"):
                for t in c["t"].cast(pa.large_binary()).to_pylist():
                    for _, features in word_runs(t, grams):
                        total += np.bincount(np.fromiter(map(known.__getitem__, features), np.int64, len(features)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInArrow(run, "bucket int, n long")
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of smoothed bucket frequencies, rounded down."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for s, t in zip(source, target)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, grams: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, n_words, n_features, weight): the sum of the gains over a text's features."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for b in batches:
            for c in slices(b, "t"):
                out = np.zeros((3, c.num_rows), np.int64)
                for i, t in enumerate(c["t"].cast(pa.large_binary()).to_pylist()):
                    for n, features in word_runs(t, grams):
                        out[:, i] += (n, len(features), gain[np.fromiter(map(known.__getitem__, features), np.int64, len(features))].sum())
                yield pa.record_batch([c["k"], *map(pa.array, out)], ["k", "n_words", "n_features", "weight"])

    rows = texts_of(docs, key, text)
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, n_words long, n_features long, weight long")


def gumbel(k: Column, seed: int) -> Column:
    """1000 times a Gumbel number drawn by hash from the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(k.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _literal(row, types: dict[str, str]) -> Column:
    return F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in KEY])


def kth(rows: DataFrame, k: int):
    """(the k-th smallest composite key, how many rows are below it, how many have it), k from 1 to the number of rows.

    Quickselect over many pivots at once: keys with the smallest hashes, other ones each round, are the pivots; one pass counts
    the rows below, at and above each exactly; only the rows strictly between the two pivots around the k-th go on, as a table.
    A round leaves about one row in 30, so ten thousand million rows take seven. Rows equal in the whole key are counted, never
    compared further, so any number of them may have the same key.
    """
    types = {c: t for c, t in rows.dtypes if c in KEY}
    key = F.struct(*[F.col(c).alias(c) for c in KEY])
    below, turn = 0, 0
    while True:
        drawn = rows.select(*KEY).orderBy(F.xxhash64(F.lit(turn), *KEY), *KEY).limit(PIVOTS * 2).distinct().orderBy(*KEY).collect()
        pivots = drawn[::max(1, len(drawn) // PIVOTS)] if len(drawn) > PIVOTS else drawn
        marks = [_literal(p, types) for p in pivots]
        counts = rows.agg(*[c for i, m in enumerate(marks) for c in (F.count_if(key < m).alias(f"l{i}"), F.count_if(key == m).alias(f"e{i}"))]).first()
        low = None
        for i, p in enumerate(pivots):
            if below + counts[f"l{i}"] < k <= below + counts[f"l{i}"] + counts[f"e{i}"]:
                return p, below + counts[f"l{i}"], counts[f"e{i}"]
            if below + counts[f"l{i}"] >= k:
                break
            low = i
        else:
            i = None
        between = F.lit(True) if low is None else key > marks[low]
        rows = stored(rows.where(between if i is None else between & (key < marks[i])).select(*KEY), "between-pivots")
        below, turn = below + (0 if low is None else counts[f"l{low}"] + counts[f"e{low}"]), turn + 1


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` 1, 2, 3, ... of rows by key. They are dealt by ranges of the key and each range is ranked for itself, after the sizes
    of the ranges before. Rows with the same key are counted first, so they cannot fill a range."""
    groups = rows.groupBy(*KEY, "score").agg(F.sum("copies").alias("copies"))
    dealt = stored(groups.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["range"], r["n"]) for r in dealt.groupBy("range").agg(F.sum("copies").alias("n")).collect())     # one row a partition
    starts, total = {}, 0
    for r, n in sizes:
        starts[r], total = total, total + n
    if not starts:
        return groups.withColumn("rank", F.lit(0).cast("long")).where("false").drop("copies")
    start = F.get(F.array(*[F.lit(starts.get(r, 0)).cast("long") for r in range(max(starts) + 1)]), F.col("range"))
    upto = start + F.sum("copies").over(Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("upto", upto).withColumn("rank", F.explode(F.sequence(F.col("upto") - F.col("copies") + 1, F.col("upto")))).drop("copies", "upto", "range")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, grams: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_features, weight, score, rank (of the drawn; null for the others).

    Features are runs of 1 to ``grams`` words, hashed into buckets; a bucket's gain is the log ratio of its share in ``target``
    and in all documents; a document's weight is the sum over its features, its score the weight and a Gumbel number, so that
    the highest scores are a sample without replacement by weight. Of the documents with ``least_words`` words or more,
    floor(percent * n / 100) are drawn, equal scores by smaller id.

    Null, empty and wordless texts have no features and weight 0. A null id draws its number as the empty text and comes after
    all others at equal scores. Repeated rows are documents of their own; equal ones share weight and score and get ranks one
    after the other. An empty table gives no rows, an empty target a uniform one. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, grams, buckets, text), bucket_counts(target, grams, buckets, text))
    scored = weights(docs, gain, grams, key, text).withColumn("score", F.col("weight") + gumbel(F.col("k"), seed))
    rows = stored(scored.select("k", "n_words", "n_features", "weight", "score", (-F.col("score")).alias("key_score"), F.col("k").isNull().alias("no_id")), "scored-documents")
    able = rows.where(F.col("n_words") >= least_words)
    draw = percent * able.count() // 100
    blank = F.lit(None).cast("long").alias("rank")
    columns = [F.col("k").alias(key), "n_features", "weight", "score"]
    if draw == 0:
        return rows.select(*columns, blank)
    last, below, equal = kth(able, draw)
    types = {c: t for c, t in rows.dtypes if c in KEY}
    at, mark = F.struct(*[F.col(c).alias(c) for c in KEY]), _literal(last, types)
    tie = rows.sparkSession.range(1).select(*[F.lit(last[c]).cast(types[c]).alias(c) for c in KEY], F.lit(-last["key_score"]).cast("long").alias("score"))
    won = able.where(at < mark).select(*KEY, "score", F.lit(1).cast("long").alias("copies")).unionByName(tie.withColumn("copies", F.lit(draw - below).cast("long")))
    lost = rows.where((F.col("n_words") < least_words) | (at > mark)).select(*columns, blank)
    if draw - below < equal:
        lost = lost.unionByName(tie.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(below + equal - draw)))).select(*columns, blank))
    return ranked(won).select(*columns, "rank").unionByName(lost)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH RECURSIVE g(i, c, k) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS steps FROM g WHERE k = 8),
src AS (SELECT doc_id, true AS own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
    UNION ALL SELECT item_id, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT doc_id, own, unnest(ws) AS w FROM src),
c AS (SELECT w, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM f GROUP BY w),
h AS (SELECT w, s, t, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS BIGINT)) AS bytes FROM c),
b AS (SELECT w, s, t, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, y: xor(x >> 8, steps[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, crc),
n AS (SELECT sum(s) AS sa, sum(t) AS ta FROM b),
gain AS (SELECT bucket, CAST(floor(1000 * ln((sum(t) + 1)::DOUBLE * ((SELECT sa FROM n) + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * ((SELECT ta FROM n) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM b GROUP BY bucket),
wg AS (SELECT w, gain FROM b JOIN gain USING (bucket)),
d AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM f JOIN wg USING (w) WHERE own GROUP BY doc_id),
sc AS (SELECT s.doc_id, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || s.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM src s LEFT JOIN d ON s.doc_id = d.doc_id WHERE own),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS BIGINT) AS rank FROM sc LEFT JOIN r ON sc.doc_id = r.doc_id
"""
