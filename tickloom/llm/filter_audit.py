"""Filter interaction audit over a sparse document-term matrix with a global dictionary (op 12)."""

from __future__ import annotations

import itertools
import json
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.blocks import PIECE, first_row, gather, pack, postings, returned, runs, unpack
from tickloom.llm.common import stored, table

#: The filters and their bits in a mask of failures; limits of the first three.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
SYMBOLS = b"#$%&*|"
#: A text that a thousandth of all documents share is hot: at most this many texts are.
HOT = 1000


def text_pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    lo = 0
    while lo < len(text):
        hi = min(lo + PIECE, len(text))
        while hi < len(text) and text[hi] not in b" \t\n\x0b\x0c\r":
            hi += 1
        yield text[lo:hi]
        lo = hi


def marks(texts: list[bytes]) -> tuple[list[bool], list[bool]]:
    """Failures of the filters on capitals and on symbols, by bytes: a code point is a byte that continues none."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    upper, symbols = [], []
    for t in texts:
        often = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        upper.append(bool(100 * often[65:91].sum() > MOST_UPPER * (len(t) - often[128:192].sum())))
        symbols.append(bool(often[symbol].any()))
    return upper, symbols


def _blocks(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """One row per document; the first one of a block has the block's words and its matrix in numbers of these words."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in gather(batches, "t"):
            texts = rows["t"].cast(pa.large_binary()).to_pylist()
            local, columns, data, sizes = {}, [], [], []
            for t in texts:
                count = Counter()
                for piece in text_pieces(t):
                    count.update(piece.split())
                columns.append(np.fromiter((local.setdefault(w, len(local)) for w in count), np.uint32, len(count)))
                data.append(np.fromiter(count.values(), np.uint32, len(count)))
                sizes.append(len(count))
            upper, symbols = marks(texts)
            n = len(texts)
            made = pa.table({
                "block": pa.array([number] * n, pa.int64()), "pos": pa.array(range(n), pa.int32()), "k": rows["k"], "part": rows["part"],
                "digest": pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary()), "upper": upper, "symbols": symbols,
                "size": pa.array(sizes, pa.int32()), "columns": pa.array(first_row([pack(np.concatenate(columns))], n), pa.binary()),
                "data": pa.array(first_row([pack(np.concatenate(data))], n), pa.binary()),
                "words": pa.array(first_row([list(local)], n), pa.list_(pa.binary()))})
            yield from made.combine_chunks().to_batches()

    return rows.mapInArrow(run, f"block long, pos int, k {kind}, part string, digest binary, upper boolean, symbols boolean, size int, columns binary, data binary, words array<binary>")


def _numbered(blocks: DataFrame) -> DataFrame:
    """(block, local, range, number, word): every distinct word has a number within its partition; the word itself is in one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, part = 0, TaskContext.get().partitionId()
        for rows, words, at, goes_on in runs(batches):
            base -= goes_on
            new = np.concatenate([[not goes_on], at[1:] != at[:-1]])
            yield from pa.table({"block": rows["block"], "local": rows["local"], "range": pa.array([part] * len(at), pa.int32()), "number": base + at,
                                 "word": words.take(pa.array(np.where(new, at, -1), mask=~new))}).combine_chunks().to_batches()
            base += len(words)

    return postings(blocks).mapInArrow(run, "block long, local int, range int, number long, word binary")


def term_matrix(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> tuple[DataFrame, DataFrame]:
    """(dictionary, shards) of the document-term matrix of whole texts.

    dictionary: term_id (0, 1, 2, ... without gaps over all words of the corpus), word. shards: one CSR matrix per block of
    documents (block, k, part, digest, upper, symbols: lists over its documents; indptr, indices: term_ids, data: counts).
    Distinct words leave a block once, meet in the partition of the word, are numbered there and return; the numbers of
    partitions before are added from one count per partition. Null and empty texts are rows without entries.
    """
    blocks = stored(_blocks(docs, key, text, part), "term-blocks")
    numbered = stored(_numbered(blocks), "term-numbers")
    sizes = numbered.groupBy("range").agg((F.max("number") + 1).alias("n")).toArrow()       # one row a partition
    offsets = np.zeros(max(sizes["range"].to_pylist(), default=0) + 2, np.int64)
    offsets[sizes["range"].to_numpy() + 1] = sizes["n"].to_numpy()
    offsets = np.cumsum(offsets)
    kind = dict(blocks.dtypes)["k"]

    def shard(rows: pa.Table, terms: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos").combine_chunks()
        local = np.empty(terms.num_rows, np.int64)
        local[terms["local"].to_numpy()] = offsets[terms["range"].to_numpy()] + terms["number"].to_numpy()
        indptr = np.concatenate([[0], np.cumsum(rows["size"].to_numpy(), dtype=np.int64)])
        total = int(indptr[-1])
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a)
        return pa.table({"block": rows["block"][:1], **{c: one(rows[c]) for c in ("k", "part", "digest", "upper", "symbols")}, "indptr": one(pa.array(indptr)),
                         "indices": one(pa.array(local[unpack(rows["columns"][0].as_py(), total)])), "data": one(pa.array(unpack(rows["data"][0].as_py(), total), pa.int32()))})

    lists = f"k array<{kind}>, part array<string>, digest array<binary>, upper array<boolean>, symbols array<boolean>"
    shards = returned(blocks, numbered.drop("word"), shard, f"block long, {lists}, indptr array<long>, indices array<long>, data array<int>")
    starts = F.array(*map(F.lit, offsets[:-1].tolist()))
    dictionary = numbered.where("word IS NOT NULL").select((F.get(starts, F.col("range")) + F.col("number")).alias("term_id"), F.decode("word", "UTF-8").alias("word"))
    return dictionary, shards


def row_counts(shards: DataFrame) -> DataFrame:
    """One row per document of the shards: its columns, n_words (row sum) and n_distinct (entries that are not zero)."""
    kind = dict(shards.dtypes)["k"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = b.slice(i, 1)
                indptr, indices, data = (s[c].flatten().to_numpy() for c in ("indptr", "indices", "data"))
                sums, seen = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (data, (data > 0) & (indices >= 0)))
                yield pa.record_batch([s["k"].flatten(), s["part"].flatten(), s["digest"].flatten(), s["upper"].flatten(), s["symbols"].flatten(),
                                       pa.array(np.diff(sums[indptr])), pa.array(np.diff(seen[indptr]))], ["k", "part", "digest", "upper", "symbols", "n_words", "n_distinct"])

    return shards.mapInArrow(run, f"k {kind}, part string, digest binary, upper boolean, symbols boolean, n_words long, n_distinct long")


def later_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (with k and digest) and ``copied``: whether a row with a smaller k has the same digest.

    Digests that a thousandth of all rows share, of which there are 1000 at most, are joined by broadcast; the others by shuffle.
    """
    groups = rows.where("k IS NOT NULL").groupBy("digest").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("least < most").select("digest", "least", "n"), "copied-texts")
    hot = F.broadcast(groups.where(F.col("n") * HOT >= rows.count()).select("digest", "least"))
    rest = groups.join(hot.select("digest"), "digest", "left_anti").select("digest", "least")
    split = rows.join(hot, "digest", "inner").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(rest, "digest", "left"))
    return split.withColumn("copied", F.coalesce(F.col("k") > F.col("least"), F.lit(False))).drop("least")


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per document: k, part, mask (bit i is set if filter i of ABCDE fails it)."""
    rows = later_copies(stored(row_counts(term_matrix(docs, key, text, part)[1]), "document-counts"))
    failing = [F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), F.col("upper"), F.col("symbols"), F.col("copied")]
    return rows.select("k", "part", sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failing)), F.lit(0)).alias("mask"))


def _labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """rows with good and toxic (0 or 1); ids with several labels have one if any says so, and null ids none."""
    of = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = rows.where("k IS NOT NULL").join(of, "k", "left").fillna(0, ["good", "toxic"])
    return known.unionByName(rows.where("k IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def _steps() -> Column:
    """All 600 steps: order (o), place (s), bit of the filter (f), bits of the filters before (b)."""
    out = [{"o": "".join(FILTERS[g] for g in order), "s": i + 1, "f": 1 << f, "b": sum(1 << g for g in order[:i])}
           for order in itertools.permutations(range(len(FILTERS))) for i, f in enumerate(order)]
    return F.from_json(F.lit(json.dumps(out)), "array<struct<o:string,s:int,f:int,b:int>>")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What five filters remove, alone and in every order, per part: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 50 words; B fewer than 65 distinct in 100 words; C more than 5 capitals A-Z in 100 code points; D any of
    ``#$%&*|``; E the text of a smaller id. Everything after the matrix is one count per (part, set of failed filters, labels).

    A null text is the empty one (it fails A, and E if a smaller id is empty or null too); a null part is the empty string; rows
    without an id never fail E and have no labels; repeated rows count each, and are no copies of one another; an empty table
    gives no rows; other columns of both tables are ignored.
    """
    n, all_masks = 1 << len(FILTERS), range(1 << len(FILTERS))
    cells = _labelled(failures(docs, key, text, part), labels, key).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    filled = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in all_masks])
    parts = cells.groupBy("part").agg(*[filled(c).alias(c) for c in ("n", "good", "toxic")])
    rows = parts.select("part", "n", "good", "toxic", F.explode(_steps()).alias("s")).select("part", "n", "good", "toxic", "s.*")

    def total(counts: str, when: str) -> Column:
        return F.expr(f"aggregate(sequence(0, {n - 1}), 0L, (t, m) -> t + if({when}, get({counts}, m), 0L))")

    now = "(m & f) <> 0 AND (m & b) = 0"
    out = rows.select("part", F.col("o").alias("filter_order"), F.col("s").alias("step"), "f", total("n", "(m & (f | b)) = 0").alias("kept"), total("n", now).alias("removed"),
                      total("n", "(m & f) <> 0 AND (m & b) <> 0").alias("redundant"), total("n", "m = f").alias("unique_fails"),
                      total("good", now).alias("good_lost"), total("toxic", now).alias("toxic_lost"))
    shares = out.groupBy("part", "f").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "f"]).drop("f")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > least THEN 16 ELSE 0 END) AS mask
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(1 << (ascii(filter_order[step]) - 65) AS INTEGER) AS bit,
    CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(CASE WHEN (mask & (bit | before)) = 0 THEN n END), 0) AS kept,
    coalesce(sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) = 0 THEN n END), 0) AS removed,
    coalesce(sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) <> 0 THEN n END), 0) AS redundant, coalesce(sum(CASE WHEN mask = bit THEN n END), 0) AS unique_fails,
    coalesce(sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) = 0 THEN good END), 0) AS good_lost,
    coalesce(sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) = 0 THEN toxic END), 0) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
