"""MinHash near-dedup with SetSketch registers: banded, estimated jointly by likelihood, verified on full sets (op 3)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, let, stored, table, words_of
from tickloom.llm.graph import components
from tickloom.llm.shingles import bitmap, distinct_sets, in_bitmap, mix, shingle_hashes, slices, texts_of, word_hashes

#: Registers, base and rate of the sketch (values b = 1.001, a = 20 make a register nearly as selective as a plain minimum).
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Bits of the map of ids whose full sets are needed.
BITS = 24
#: Members of a bucket up to which those apart are joined in pairs; beyond, groups are cut into tiles of about TILE members.
SMALL, TILE = 20, 2000


def sketch(values: np.ndarray, bounds: np.ndarray, seed: int = 1) -> np.ndarray:
    """SetSketch registers, one row per set: register = clip(floor(1 - log_b(least arrival)), 0, TOP).

    Every element sends arrivals to random registers by a Poisson process of its own, seeded by its hash; a register keeps the
    earliest arrival over all elements, so registers of a union are the maxima of registers. Arrivals are made in ascending
    order and only up to a time by which each register is surely reached, about 8.5 / n: some REGISTERS * 8.5 arrivals a set,
    whatever its size. The rare set with an unreached register is drawn on to a later time.
    """
    n = np.diff(bounds)
    least = np.full((len(n), REGISTERS), np.inf)
    todo, factor = np.flatnonzero(n > 0), math.log(REGISTERS) + 3
    while len(todo):
        count = n[todo]
        doc = np.repeat(np.arange(len(todo)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[todo], count)
        state, time = values[at] ^ np.uint64(0xA24BAED4963EE407 * seed % (1 << 64)), np.zeros(len(at))
        until = factor / count
        flat = np.full(len(todo) * REGISTERS, np.inf)
        while len(doc):
            state = state + np.uint64(0x9E3779B97F4A7C15)
            r = mix(state)
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / REGISTERS
            live = np.flatnonzero(time <= until[doc])
            state, time, doc = state[live], time[live], doc[live]
            register = (mix(r[live]) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(flat, doc * REGISTERS + register, time)
        flat = flat.reshape(len(todo), REGISTERS)
        done = np.isfinite(flat).all(1)
        least[todo[done]] = flat[done]
        todo, factor = todo[~done], factor * 2
    k = np.floor(1 - np.log(least / RATE) / math.log(BASE))
    return np.where(np.isfinite(k), np.clip(k, 0, TOP), 0).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    r = registers.astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches, by maximum likelihood of how often a register of one is above, below or equal to
    that of the other, given both sets' sizes. Concave in the similarity: solved by 30 golden sections at once."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    return likely(above, below, na, nb)


def likely(above: np.ndarray, below: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    u = na / np.maximum(na + nb, 1)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    floor = lambda x: np.log(np.maximum(x, 1e-12))

    def value(j):
        x, y = p(u - v * j), p(v - u * j)
        return above * floor(x) + below * floor(y) + (REGISTERS - above - below) * floor(1 - x - y)

    lo, hi, g = np.zeros(len(u)), np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12), (math.sqrt(5) - 1) / 2
    for _ in range(30):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = value(x) > value(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def _sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(k, n, digest of the full set, registers, band keys), no shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in slices(b, "t"):
                v, at = distinct_sets(*shingle_hashes(*word_hashes(c["t"]), width))
                regs = sketch(v, at)
                keys = band_keys(regs)
                n = np.diff(at)
                yield pa.record_batch([c["k"], pa.array(n), pa.array([hashlib.md5(v[i:j].tobytes()).digest() for i, j in zip(at[:-1], at[1:])], pa.binary()),
                                       pa.array([r.tobytes() for r in regs], pa.binary()),
                                       pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))],
                                      ["k", "n", "d", "registers", "bands"])

    rows = texts_of(docs, key, text)
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, n long, d binary, registers binary, bands array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(k, s): full sets of the documents whose ids are asked for (and a few more, by the bitmap)."""
    asked = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("k").alias("h")), "h", BITS))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.filter(pa.array(in_bitmap(asked.value, b["h"].to_numpy())))
            for c in slices(c, "t"):
                v, at = distinct_sets(*shingle_hashes(*word_hashes(c["t"]), width))
                yield pa.record_batch([c["k"], pa.array([v[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], ["k", "s"])

    rows = texts_of(docs, key, text).where("k IS NOT NULL").withColumn("h", F.xxhash64("k"))
    return rows.mapInArrow(some, f"k {dict(rows.dtypes)['k']}, s binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(both) - inter))
            yield pa.record_batch([b["a"], b["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    full = (pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("x")), "a")
            .join(sets.select(F.col("k").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y"))
    return full.mapInArrow(run, f"a {kind}, b {kind}")


def _likely_pairs(pairs: DataFrame, reps: DataFrame, least: float, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose sketches make it likely enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("x", "y"))
            ok = similarity(x, y, b["n"].to_numpy(), b["m"].to_numpy()) >= least
            yield pa.record_batch([b["a"], b["b"]], ["a", "b"]).filter(pa.array(ok))

    kind = dict(pairs.dtypes)["a"]
    one = reps.select(F.col("k").alias("a"), "n", F.col("registers").alias("x"))
    two = reps.select(F.col("k").alias("b"), F.col("n").alias("m"), F.col("registers").alias("y"))
    full = pairs.join(one, "a").join(two, "b").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return full.mapInArrow(run, f"a {kind}, b {kind}")


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, step: int = 4096) -> np.ndarray:
    """Intersection sizes of all (left, right) pairs of sets, exactly: a product of 0/1 matrices, some thousand values at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, value, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[value] > 1                                     # what one set alone holds is in no intersection
    value, owner = np.unique(value[keep], return_inverse=True)[1], owner[keep]
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    total = np.zeros((len(left), len(right)), np.float32)
    ends = np.searchsorted(value, np.arange(0, (int(value[-1]) + 1 if len(value) else 0) + step, step))
    for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        x = np.zeros((len(sets), step), np.float32)
        x[owner[lo:hi], value[lo:hi] - i * step] = 1
        total += x[left] @ x[right].T
    return total.astype(np.int64)


def _tile_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between members of large groups. Members are dealt to tiles by hash and every two tiles meet in a task of their own,
    which compares all their full sets and sends on a spanning forest of the links it finds, never the pairs."""
    kind = dict(members.dtypes)["k"]

    def run(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        side, n = g["t"].to_numpy(), g["n"].to_numpy()
        left, right = np.flatnonzero(side == g["p"][0].as_py()), np.flatnonzero(side == g["q"][0].as_py())
        out_a, out_b = [], []
        if len(left) and len(right):
            both = shared_counts([np.frombuffer(x, np.uint64) for x in g["s"].to_pylist()], left, right)
            near = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
            seen_left, seen_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
            for i in range(len(left)):
                if seen_left[i]:
                    continue
                front, root = np.array([i]), left[i]
                seen_left[i] = True
                while len(front):                                # breadth first over the links between the two sides
                    hit = np.flatnonzero(near[front].any(0) & ~seen_right)
                    seen_right[hit] = True
                    front = np.flatnonzero(near[:, hit].any(1) & ~seen_left) if len(hit) else hit
                    seen_left[front] = True
                    new = [x for x in np.concatenate([right[hit], left[front]]).tolist() if x != root]
                    out_a += [root] * len(new)
                    out_b += new
        return pa.table([g["k"].take(pa.array(out_a, pa.int64())), g["k"].take(pa.array(out_b, pa.int64()))], ["a", "b"])

    return members.groupBy("root", "p", "q").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. Equal sets are one class with one
    representative, so thousands of copies cost one sketch each and no pairs. Representatives meet in the buckets of 40 bands of
    6 registers: a pair at similarity 0.85 shares a bucket with probability 1 - 6e-9, at 0.8 1 - 5e-6. In a bucket only links
    between different components matter, so pairs are not expanded: all members meet the smallest one, and what is still in
    different components then is compared pair by pair where the bucket is small. These
    pairs pass the size test and the likelihood estimate (seven standard errors below the threshold) before the exact test on
    full sets; only that makes a link. Large buckets that remain apart are joined into groups, whose members are compared on
    full sets tile by tile, each tile pair in a task that returns a spanning forest.

    Null, empty and blank texts have no set and are linked with nothing; a text shorter than ``width`` words is one shingle;
    rows without an id take no part (component_id null, kept); repeated rows get equal answers; an empty table gives no rows;
    further columns of the input are ignored.
    """
    rows = stored(_sketches(docs, key, text, width), "sketches")
    full = rows.where("n > 0 AND k IS NOT NULL")
    classes = stored(full.groupBy("d").agg(F.min("k").alias("rep")), "classes")
    reps = stored(full.join(classes, "d").where("k = rep").dropDuplicates(["k", "d"]).select("k", "n", "registers", "bands"), "representatives")
    least = percent / 100 - 7 * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    posted = reps.select(F.explode("bands").alias("h"), "k")
    shared = posted.groupBy("h").agg(F.min("k").alias("hub"), F.max("k").alias("last"), F.count(F.lit(1)).alias("size")).where("hub < last")
    buckets = stored(posted.join(shared, "h"), "buckets")
    ids = buckets.select("k").distinct()
    sets = stored(_sets(docs, ids, key, text, width).join(ids, "k", "left_semi").dropDuplicates(["k"]), "sets")

    star = buckets.where("k > hub").select(F.col("hub").alias("a"), F.col("k").alias("b")).distinct()
    links = stored(_verify(_likely_pairs(star, reps, least, percent), sets, percent), "links")

    # members of buckets that still hold more than one component
    roots = components(links)
    now = buckets.select("h", "k", "hub", "size").join(roots.withColumnRenamed("node", "k"), "k", "left").select("h", "k", "hub", "size", F.coalesce("root", "k").alias("c"))
    more = now.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("h")
    left = stored(now.join(more, "h"), "apart")
    small, large = left.where(F.col("size") <= SMALL), left.where(F.col("size") > SMALL)
    one, two = small.select("h", F.col("k").alias("a"), F.col("c").alias("ca")), small.select("h", F.col("k").alias("b"), F.col("c").alias("cb"))
    met = _likely_pairs(one.join(two, "h").where("a < b AND ca <> cb").select("a", "b").distinct().join(star, ["a", "b"], "left_anti"), reps, least, percent)
    # large buckets hang together: their members are compared once, not once a bucket
    groups = components(large.select("hub", "k"), "hub", "k").withColumnRenamed("node", "k")
    groups = stored(groups.join(groups.groupBy("root").count(), "root"), "large-groups")
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    dealt = (groups.join(sets, "k").join(reps.select("k", "n"), "k").withColumn("t", F.pmod(F.xxhash64("k"), tiles).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
             .select("root", "k", "n", "s", "t", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q")))
    links = stored(links.union(_verify(met, sets, percent)).union(_tile_links(dealt, percent)), "links")
    roots = components(links)
    final = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("d", F.coalesce("root", "rep").alias("root"))
    own = F.when((F.col("n") > 0) & F.col("k").isNotNull(), F.col("root")).otherwise(F.col("k"))
    return (rows.select("k", "n", "d").join(final, "d", "left")
            .select(F.col("k").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("k") == own, F.lit(True)).alias("kept")))


def shingle_array(text: Column, width: int) -> Column:
    """The distinct shingles of a text as ascending 64-bit hashes, by DataFrame functions."""
    def made(w):
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
        return F.when(F.size(w) >= width, F.sort_array(F.array_distinct(runs))).when(F.size(w) > 0, F.array(F.xxhash64(F.size(w), w))).otherwise(F.array().cast("array<bigint>"))
    return let(words_of(ascii_lower(F.coalesce(text.cast("string"), F.lit("")))), made)


def band_array(shingles: Column) -> Column:
    """Keys of up to 32 bands: the least shingle of each of 128 ranges of hashes, four neighbouring ranges a band."""
    changes = lambda a, bits: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.shiftright(F.get(a, i), bits) != F.shiftright(F.get(a, i - 1), bits)))

    def keys(least):
        rest = lambda i, j: F.when(F.shiftright(F.get(least, i + j), 59) == F.shiftright(F.get(least, i), 59), F.get(least, i + j))
        return F.transform(changes(least, 59), lambda i: F.xxhash64(F.get(least, i), rest(i, 1), rest(i, 2), rest(i, 3)))
    return F.when(F.size(shingles) > 0, let(F.transform(changes(shingles, 57), lambda i: F.get(shingles, i)), keys)).otherwise(F.array().cast("array<bigint>"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, near) of the pairs whose ids both have sets (k, s): whether 100 * intersection >= percent * union, by DataFrame functions.
    Equal sets are told by their hash, so only others travel."""
    marks = sets.select("k", F.xxhash64("s").alias("d"))
    told = pairs.join(marks.select(F.col("k").alias("a"), F.col("d").alias("da")), "a").join(marks.select(F.col("k").alias("b"), F.col("d").alias("db")), "b").select("a", "b", (F.col("da") == F.col("db")).alias("near"))
    met = told.where("NOT near").select("a", "b").join(sets.select(F.col("k").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return told.where("near").union(met.select("a", "b", (100 * both >= percent * (F.size("x") + F.size("y") - both)).alias("near")))


def copies(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What ``with_copies`` returns, and the links (a, b) that it found on full sets: all pairs of buckets up to SMALL, and of
    those in larger ones each with the smallest document that heads one of its buckets."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    sets = rows.select("k", shingle_array(F.col("t"), width).alias("s"))
    posted = stored(sets.select("k", let(F.col("s"), lambda s: F.struct(F.size(s).alias("n"), band_array(s).alias("bands"))).alias("x")).select("k", "x.n", F.explode("x.bands").alias("h")), "bands")
    shared = posted.groupBy("h").agg(F.min(F.struct("k", "n")).alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("size")).where("first.k < last").select("h", "first", "size")
    buckets = stored(posted.join(shared, "h"), "buckets")
    small, large = buckets.where(F.col("size") <= SMALL), buckets.where((F.col("size") > SMALL) & (F.col("k") > F.col("first.k")))
    one, two = small.select("h", F.col("k").alias("a"), "n"), small.select("h", F.col("k").alias("b"), F.col("n").alias("m"))
    met = one.join(two, "h").where(F.col("a") < F.col("b")).select("a", "b", "n", "m").union(large.groupBy("k").agg(F.min("first").alias("first"), F.min("n").alias("n")).select("first.k", "k", "first.n", "n"))
    pairs = stored(met.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    full = stored(rows.join(ids, "k", "left_semi").select("k", shingle_array(F.col("t"), width).alias("s")), "sets")
    links = stored(linked(pairs, full, percent).where("near").select("a", "b").distinct(), "copy-links", stays=True)
    return components(links.union(large.select("first.k", "k"))).select(F.col("node").alias(key), F.col("root").alias("component_id")), links


def with_copies(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) of the documents that are linked with another one as ``near_duplicates`` links them, by DataFrame functions alone.

    Documents meet in 32 bands of four least shingles; two at similarity 0.8 miss each other in all with probability 5e-8. Where
    up to SMALL meet, each pair is compared on full sets; those of larger buckets count as linked, so a few may have no copy, and
    a component may hold several of ``near_duplicates``. Texts without words and rows without an id have none.
    """
    return copies(docs, width, percent, key, text)[0]


def hidden_copies(links: DataFrame, after: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of documents linked on whole texts that ``near_duplicates`` no longer knows for copies once lines are gone.

    ``after`` are the documents as they are then, with ``n_dropped``. Where a group of ``links`` holds two documents that are no
    longer similar enough, all of the group but its first remaining document are returned, which are copies of each other on whole texts.
    """
    known = links.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    rows = stored(after.join(known, key, "left_semi").select(F.col(key).alias("k"), F.col(text).alias("t"), "n_dropped"), "linked-documents")
    cut = rows.where("n_dropped > 0").select("k").distinct()
    ends = [links.join(cut.withColumnRenamed("k", end), end, "left_semi").select("a", "b") for end in "ab"]
    asked = stored(ends[0].union(ends[1]).distinct(), "links-of-changed")
    ids = asked.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    sets = stored(rows.join(ids, "k", "left_semi").select("k", shingle_array(F.col("t"), width).alias("s")), "sets-of-changed")
    apart = stored(linked(asked, sets, percent).groupBy("a", "b").agg(F.max("near").alias("near")).where("NOT near").select("a"), "hidden-links")
    if apart.isEmpty():
        return links.select(F.col("a").alias(key)).where(F.lit(False))
    groups = components(links)
    groups = groups.join(groups.join(apart.select(F.col("a").alias("node")), "node", "left_semi").select("root").distinct(), "root", "left_semi")
    there = stored(groups.join(rows.select(F.col("k").alias("node")).distinct(), "node", "left_semi"), "hidden-groups")
    stay = there.groupBy("root").agg(F.min("node").alias("node"))
    return stored(there.join(stay, ["root", "node"], "left_anti").select(F.col("node").alias(key)), "hidden-copies", stays=True)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
