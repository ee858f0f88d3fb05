"""Suffix-array dedup: every byte in a 100-byte string that also starts earlier is removed (op 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stored, table
from tickloom.llm.shingles import bitmap, buffers, in_bitmap, mix, slices

#: Leading bytes by which suffixes are dealt to buckets; bits of the map of leading strings that occur twice.
LEAD, BITS = 32, 27
#: Suffixes with one leading string that a bucket may hold; more are compared by the shuffle instead.
HOT = 200_000
#: Windows sorted at once.
CHUNK = 2_000_000
_BYTES = np.random.default_rng(10).integers(1, 1 << 63, 256, np.uint64)
_LONG = (1 << 63) - 1


def anchors(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text index, position, first window, windows, key of the leading string) of the suffixes that stand for all windows.

    A window of ``width`` bytes is represented by the leftmost of its positions with the least hash of the LEAD bytes there, a
    choice that only its content makes: equal windows have their representative at equal offsets. Consecutive windows share
    one, so about one suffix in 35 is enough. Positions count from the start of ``data``, which is not split between texts.
    """
    n, span = len(data), width - LEAD + 1
    if n < width:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h, size = _BYTES[data], 1
    while size < LEAD:
        h = h[:len(h) - size] * np.uint64(0x9E3779B97F4A7C15 ^ (size << 7)) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    h = mix(h)
    m, size = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= span:
        m = np.minimum(m[:len(m) - size], m[size:])
        size *= 2
    if size < span:
        m = np.minimum(m[:len(m) - (span - size)], m[span - size:])
    at = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(bounds, np.arange(len(at)), "right") - 1
    ok = np.flatnonzero(np.arange(len(at)) + width <= bounds[doc + 1])
    if not len(ok):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    p, d = at[ok], doc[ok]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(ok)]]))
    return d[first], p[first], ok[first], count, h[p[first]]


def _texts(c: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = buffers(c["t"])
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the intervals of each document (an integer that names it)."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    base = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)])) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.concatenate([[True], (start + base)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return doc[at], start[at], (reach - base)[np.concatenate([at[1:] - 1, [len(doc) - 1]])]


def equal_windows(cls: np.ndarray, at: np.ndarray, flat: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, class) of the windows that equal another one of their class: multikey quicksort over words of 8 bytes, whole
    levels at a time. A window that is alone in its class at some level leaves; the others go on to the next word."""
    live = np.arange(len(cls))
    starts = [*range(0, width - 8, 8), width - 8]
    words = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))         # the 8 bytes at every place
    # words at the edges tell windows apart soonest, as the middle is around the common leading string
    for w in [None] + sorted(starts, key=lambda s: min(s, width - 8 - s)):
        if w is None:
            order = np.argsort(cls[live], kind="stable")
            new = cls[live][order][1:] != cls[live][order][:-1]
        else:
            word = words[at[live] + w]
            order = np.lexsort((word, cls[live]))
            c, word = cls[live][order], word[order]
            new = (c[1:] != c[:-1]) | (word[1:] != word[:-1])
        head = np.concatenate([[True], new])
        alone = head & np.concatenate([new, [True]])
        ids = np.cumsum(head)
        live = live[order]
        cls[live] = ids
        live = live[~alone]
        if not len(live):
            break
    return live, cls[live]


def resolve(key: np.ndarray, doc: np.ndarray, dig: np.ndarray, first: np.ndarray, lead: np.ndarray, count: np.ndarray, seg: np.ndarray, off: np.ndarray, width: int):
    """(row, start, end) of the runs of bytes of each suffix row covered by a window that another row has earlier."""
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    order = np.argsort(key, kind="stable")
    k = key[order]
    group = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
    many = np.bincount(group)[group] > 1
    order, group = order[many], group[many]
    by = np.lexsort((first, dig, doc))
    moved = np.any([x[by][1:] != x[by][:-1] for x in (doc, dig, first)], axis=0)
    place = np.empty(len(key), np.int64)
    place[by] = np.cumsum(np.concatenate([[0], moved]))             # one place for one occurrence, also where the table repeats it
    # rows equal to an earlier one as a whole are covered by it; only different suffixes are taken apart
    raw, size = seg.tobytes(), count + width - 1
    best: dict[tuple, int] = {}
    rest, gone = [], []
    for i in order[np.argsort(place[order], kind="stable")].tolist():
        j = best.setdefault((raw[off[i]:off[i] + size[i]], int(lead[i])), i)
        if j == i:
            rest.append(i)
        elif place[i] != place[j]:
            gone.append(i)
    is_rest = np.zeros(len(key), bool)
    is_rest[rest] = True
    group, order = group[is_rest[order]], order[is_rest[order]]
    gone = np.array(gone, np.int64)
    many = np.bincount(group, minlength=1)[group] > 1
    order, group = order[many], group[many]
    ends = np.cumsum(count[order])
    rows_out, starts_out, stops_out = [gone], [first[gone]], [first[gone] + size[gone]]
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right"))
        hi = max(hi, lo + 1)
        while hi < len(order) and group[hi] == group[hi - 1]:       # whole groups
            hi += 1
        rows = order[lo:hi]
        c = count[rows]
        r = np.repeat(np.arange(len(rows)), c)
        j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        back = lead[rows][r] - j                                     # bytes before the leading string
        cls = group[lo:hi][r] * (width + 1) + back
        live, same = equal_windows(cls, off[rows][r] + j, seg, width)
        if len(live):
            rank = place[rows[r[live]]]
            by = np.lexsort((rank, same))
            live, same, rank = live[by], same[by], rank[by]
            head = np.concatenate([[True], same[1:] != same[:-1]])
            later = live[rank > rank[np.maximum.accumulate(np.where(head, np.arange(len(same)), 0))]]
            rows_out.append(rows[r[later]])
            starts_out.append(first[rows[r[later]]] + j[later])
            stops_out.append(starts_out[-1] + width)
        lo = hi
    return merged(np.concatenate(rows_out), np.concatenate(starts_out), np.concatenate(stops_out))


_COVER = "kd long, dig long, lo long, hi long"


def covered(docs: DataFrame, width: int = 100, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(kd, dig, lo, hi): byte intervals to remove, of the document with that id (the largest long: none) and text hash."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LONG)).alias("kd"), F.xxhash64(t).alias("dig"), t.alias("t")).where(F.octet_length("t") >= width)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in slices(b, "t"):
                keys, n = np.unique(anchors(*_texts(c), width)[4], return_counts=True)
                keys = np.concatenate([keys, keys[n > 1]])          # twice is as good as often
                bucket = (keys >> np.uint64(40)) % np.uint64(parts)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(parts + 1))
                full = [i for i in range(parts) if ends[i + 1] > ends[i]]
                yield pa.record_batch([pa.array(full, pa.int32()), pa.array([keys[order[ends[i]:ends[i + 1]]].tobytes() for i in full], pa.binary())], ["bucket", "keys"])

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.sort(np.frombuffer(b"".join(x for b in batches for x in b["keys"].to_pylist()), np.uint64))
        again = held[1:][held[1:] == held[:-1]]
        yield pa.record_batch([pa.array(np.unique(again).view(np.int64))], ["h"])

    repeated = rows.select("t").mapInArrow(leads, "bucket int, keys binary").repartition(parts, "bucket").mapInArrow(twice, "h long")
    seen = spark.sparkContext.broadcast(bitmap(repeated, "h", BITS))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in slices(b, "t"):
                data, bounds = _texts(c)
                d, p, s, n, h = anchors(data, bounds, width)
                hit = np.flatnonzero(in_bitmap(seen.value, h))
                if not len(hit):
                    continue
                d, p, s, n, h = d[hit], p[hit], s[hit], n[hit], h[hit]
                kd, dig = c["kd"].to_numpy()[d], c["dig"].to_numpy()[d]
                raw = data.tobytes()
                segs = [raw[i:i + m + width - 1] for i, m in zip(s.tolist(), n.tolist())]
                start, lead = s - bounds[d], p - s
                # equal suffixes of this piece: the earliest goes on, the others are covered by it (a map-side combine)
                best: dict[tuple, int] = {}
                order = np.lexsort((start, dig, kd))
                keep, gone = [], []
                for i in order.tolist():
                    (keep if best.setdefault((segs[i], int(lead[i])), i) == i else gone).append(i)
                gone = [i for i in gone if not _same(best[segs[i], int(lead[i])], i, kd, dig, start)]
                keep_a, gone_a = np.array(keep, np.int64), np.array(gone, np.int64)
                yield pa.record_batch([pa.array(h[keep_a].view(np.int64)), pa.array(kd[keep_a]), pa.array(dig[keep_a]), pa.array(start[keep_a]), pa.array(start[keep_a]),
                                       pa.array(lead[keep_a]), pa.array(n[keep_a]), pa.array([segs[i] for i in keep], pa.binary())], _SUFFIX_NAMES)
                if len(gone):
                    g, lo, hi = merged(np.unique(np.stack([kd[gone_a], dig[gone_a]]), axis=1, return_inverse=True)[1].ravel(), start[gone_a], start[gone_a] + n[gone_a] + width - 1)
                    names = np.unique(np.stack([kd[gone_a], dig[gone_a]]), axis=1)
                    none = pa.nulls(len(g), pa.int64())
                    yield pa.record_batch([none, pa.array(names[0][g]), pa.array(names[1][g]), pa.array(lo), pa.array(hi), none, none, pa.nulls(len(g), pa.binary())], _SUFFIX_NAMES)

    found = stored(rows.mapInArrow(suffixes, "h long, kd long, dig long, lo long, hi long, lead long, n long, seg binary"), "suffixes")
    inside = found.where("h IS NULL").select("kd", "dig", "lo", "hi")
    across = found.where("h IS NOT NULL").select("h", "kd", "dig", F.col("lo").alias("first"), "lead", "n", "seg")
    counts = across.groupBy("h").count()
    busy = stored(counts.where(F.col("count") > hot).select("h"), "busy-leads")
    calm = across.join(busy, "h", "left_anti")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        get = lambda x: whole[x].to_numpy()
        seg, off = buffers(whole["seg"].chunk(0))
        kd, dig = get("kd"), get("dig")
        row, lo, hi = resolve(get("h"), kd, dig, get("first"), get("lead"), get("n"), seg, off[:-1], width)
        yield pa.record_batch([pa.array(x) for x in (kd[row], dig[row], lo, hi)], ["kd", "dig", "lo", "hi"])

    # Spark samples the splitters; suffixes with one leading string never part, so no pair lies across a boundary
    near = calm.repartitionByRange(parts, "h").mapInArrow(bucket, _COVER)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seg, off = buffers(b["seg"])
            raw = seg.tobytes()
            n, lead, first = (b[x].to_numpy() for x in ("n", "lead", "first"))
            for i in range(b.num_rows):
                m = int(n[i])
                names = [hashlib.md5(raw[off[i] + j:off[i] + j + width]).digest() for j in range(m)]
                yield pa.record_batch([pa.array(names, pa.binary()), pa.array([b["kd"][i].as_py()] * m, pa.int64()), pa.array([b["dig"][i].as_py()] * m, pa.int64()), pa.array(np.arange(first[i], first[i] + m))],
                                      ["w", "kd", "dig", "lo"])

    each = across.join(busy, "h", "left_semi").mapInArrow(windows, "w binary, kd long, dig long, lo long")
    earliest = each.groupBy("w").agg(F.min(F.struct("kd", "dig", "lo")).alias("m"))
    far = each.join(earliest, "w").where(F.struct("kd", "dig", "lo") > F.col("m")).select("kd", "dig", "lo", (F.col("lo") + width).alias("hi"))
    return inside.union(near).union(far)


_SUFFIX_NAMES = ["h", "kd", "dig", "lo", "hi", "lead", "n", "seg"]


def _same(a: int, b: int, kd: np.ndarray, dig: np.ndarray, start: np.ndarray) -> bool:
    """Two rows that are one occurrence: the table holds the document twice."""
    return kd[a] == kd[b] and dig[a] == dig[b] and start[a] == start[b]


def dedup(docs: DataFrame, width: int = 100, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, spans (removed runs of UTF-8 bytes: start, end), kept (the other bytes).

    A byte goes if some string of ``width`` bytes over it also starts earlier: in a document with a smaller id, or before in the
    same one. Strings are judged on the input and never cross documents.

    Not every suffix is sorted: equal strings of ``width`` bytes have their representative suffix at the same offset, so it is
    enough to take these (one in 35), drop those whose leading 32 bytes occur once (a bitmap of 16 MB tells, whatever the
    input's size; when it fills, more rows travel, and results stay), and range-partition the rest by leading string. Each
    bucket is sorted by multikey quicksort on the bytes themselves. Equal suffixes of one piece of input are combined before
    the shuffle, so a passage that a third of all documents share costs a row per piece; a leading string with over ``hot``
    different suffixes is compared by a distributed aggregation over its windows (128-bit hashes) instead of in one bucket.

    Null texts are empty; texts under ``width`` bytes keep everything; documents without an id come last, by text hash, as do
    different texts with one id; rows equal in id and text are one document and get equal results; an empty table gives no
    rows; further columns of the input are ignored. Ids are whole numbers.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(key).cast("long"), F.lit(_LONG)).alias("kd"), F.xxhash64(t).alias("dig"), t.alias("t"))
    cuts = covered(docs, width, hot, key, text).groupBy("kd", "dig").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    kind = dict(base.dtypes)["k"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in slices(b, "t"):
                data, bounds = buffers(c["t"])
                spans, kept, sizes = [], [], np.diff(bounds)
                for i, cut in enumerate(c["cuts"].to_pylist()):
                    raw = data[bounds[i]:bounds[i + 1]].tobytes()
                    lo, hi = (np.array([x[y] for x in cut or []], np.int64) for y in ("lo", "hi"))
                    _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, hi)
                    spans.append([{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist())])
                    edges = [0, *(z for x in zip(lo.tolist(), hi.tolist()) for z in x), len(raw)]
                    kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])))
                yield pa.record_batch([c["k"], pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                                      ["k", "n_bytes", "spans", "kept"])

    return (base.join(cuts, ["kd", "dig"], "left").select("k", "t", "cuts")
            .mapInArrow(remove, f"k {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary").withColumnRenamed("k", key))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
