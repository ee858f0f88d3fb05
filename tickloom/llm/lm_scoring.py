"""LM scoring with a sharded Elias-Fano trigram trie learned from the corpus itself (op 1)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import remainder, table
from tickloom.llm.elias_fano import Trie
from tickloom.llm.shingles import mix, slices, word_hashes

#: Hashes of the end of a text and of what stands before its first word.
END, START = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
#: Tokens of a block of documents; a context word's trigrams are dealt by the word before it from this count and share of all tokens on.
BLOCK_TOKENS, HOT_COUNT, HOT_SHARES = 4_500_000, 1_000_000, 4096
#: Inside a shard words are told apart by 48 bits of their hash: among half a million words two are taken for one with
#: probability 0.0005. Counts of words are by all 64 bits.
SHORT = np.uint64(16)
DISCOUNT = 0.75
#: Occurrences from which a trie is made (unless one middle word has more), and trigrams asked for at once.
TRIE_TOKENS, QUERIES = 500_000, 1 << 17


def squeeze(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes (most are small)."""
    import zstandard
    kind = np.uint32 if not len(x) or int(x.max()) < 1 << 32 else np.uint64
    planes = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, kind().itemsize).T
    return bytes([kind().itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}")[:, 0].astype(np.int64)


def squeeze_hashes(h: np.ndarray) -> bytes:
    """Ascending hashes by their differences."""
    return squeeze(np.diff(h, prepend=np.uint64(0)))


def expand_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data).view(np.uint64), dtype=np.uint64)


_BLOCK = "block long, ids array<{0}>, train array<boolean>, n array<bigint>, tokens binary, words binary"


def blocks(docs: DataFrame, key: str, text: str, folds: int) -> DataFrame:
    """Documents in blocks of about BLOCK_TOKENS tokens: token numbers into the block's own ascending list of word hashes."""
    rows = docs.select(F.col(key).alias("k"), (remainder(F.col(key), folds) != 0).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, serial = TaskContext.get().partitionId(), 0
        ids, train, sizes, hashes, held = [], [], [], [], 0

        def flush():
            tokens = np.concatenate(hashes)
            words, number = np.unique(tokens, return_inverse=True)
            return pa.record_batch([pa.array([part << 32 | serial], pa.int64()), pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                                    pa.array([np.concatenate(train).tolist()], pa.list_(pa.bool_())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                                    pa.array([squeeze(number)], pa.binary()), pa.array([squeeze_hashes(words)], pa.binary())], ["block", "ids", "train", "n", "tokens", "words"])

        for b in batches:
            for c in slices(b, "t"):
                h, at = word_hashes(c["t"])
                ids.append(c["k"])
                train.append(c["train"].to_numpy(zero_copy_only=False))
                sizes.append(np.diff(at) + 1)
                hashes.append(np.insert(h, at[1:], END))
                held += len(hashes[-1])
                if held >= BLOCK_TOKENS:
                    yield flush()
                    serial, held = serial + 1, 0
                    ids, train, sizes, hashes = [], [], [], []
        if held:
            yield flush()

    return rows.mapInArrow(run, _BLOCK.format(kind))


def _by_range(h: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the equal ranges of hashes in an ascending list."""
    return np.searchsorted(h, np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)) if parts > 1 else np.zeros(0, np.int64)


def counts(data: DataFrame, parts: int) -> DataFrame:
    """For every block and range of hashes the corpus counts of the block's words, and the range's sums (kinds, tokens)."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, train, n, tokens, words in zip(*(b[c].to_pylist() for c in ("block", "train", "n", "tokens", "words"))):
                h, number = expand_hashes(words), expand(tokens)
                c = np.bincount(number[np.repeat(train, n)], minlength=len(h))
                cut = [0, *_by_range(h, parts), len(h)]
                pieces = [(squeeze_hashes(h[i:j]), squeeze(c[i:j])) for i, j in zip(cut[:-1], cut[1:])]
                yield pa.record_batch([pa.array([block] * parts), pa.array(range(parts), pa.int32()), pa.array([x for x, _ in pieces], pa.binary()), pa.array([x for _, x in pieces], pa.binary())],
                                      ["block", "range", "words", "c"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for b in batches:
            for block, r, words, c in zip(*(b[x].to_pylist() for x in ("block", "range", "words", "c"))):
                held[r].append((block, words, c))
        for r, rows in held.items():
            hs = [expand_hashes(w) for _, w, _ in rows]
            every, at = np.unique(np.concatenate(hs), return_inverse=True)
            c = np.bincount(at, np.concatenate([expand(x) for *_, x in rows]).astype(np.float64), len(every)).astype(np.int64)
            ends = np.cumsum([len(h) for h in hs])
            for (block, *_), lo, hi in zip(rows, ends - [len(h) for h in hs], ends):
                yield pa.record_batch([pa.array([block]), pa.array([r], pa.int32()), pa.array([squeeze(c[at[lo:hi]])], pa.binary()), pa.array([int((c > 0).sum())]), pa.array([int(c.sum())])],
                                      ["block", "range", "c", "kinds", "tokens"])

    return (data.mapInArrow(send, "block long, range int, words binary, c binary").repartition(parts, "range")
            .mapInArrow(total, "block long, range int, c binary, kinds long, tokens long"))


#: One schema for what goes to the shards (trigrams, or a block's documents passing by) ...
_SENT = "shard int, block long, ids array<{0}>, held array<boolean>, n array<bigint>, known array<bigint>, base array<double>, all long, hot binary, v binary, vi binary, w binary, c binary, ui binary, wi binary, doc binary, kinds long"
#: ... and for what comes back (scores of some documents of a block, or its documents).
_BACK = "block long, shard int, ids array<{0}>, held array<boolean>, n array<bigint>, known array<bigint>, base array<double>, all long, doc binary, score binary"


def _send(shards: int, schema: pa.Schema):
    """Of one block and its words' corpus counts: the documents' unigram figures, and its trigrams dealt to shards."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left[c][0].as_py() for c in ("block", "train", "n", "tokens", "words")}
        right = right.sort_by("range")
        c = np.concatenate([expand(x) for x in right["c"].to_pylist()])
        kinds, every = sum(right["kinds"].to_pylist()), sum(right["tokens"].to_pylist())
        h, number, n = expand_hashes(row["words"]), expand(row.pop("tokens")).astype(np.int32), np.array(row["n"])
        first = np.cumsum(n) - n
        unigram = np.log10((c + 0.1) / (every + 0.1 * (kinds + 1)))
        out = [dict(shard=row["block"] % shards, block=row["block"], ids=left["ids"][0], held=[not x for x in row["train"]], n=row["n"], known=np.add.reduceat((c > 0)[number], first, dtype=np.int64),
                    base=np.add.reduceat(unigram[number], first), all=every)]
        # context words: number len(h) is the place before a text; 32-bit arrays keep a block's memory small
        v = np.concatenate([number[:1], number[:-1]])
        v[first] = len(h)
        u = np.concatenate([v[:1], v[:-1]])
        u[first] = len(h)
        hashes, count = np.append(h, START), np.append(c, c[h == END].sum())
        classes = np.maximum(1, np.minimum(-(-count * HOT_SHARES // max(every, 1)), count // HOT_COUNT))
        name, hot = hashes[v], classes[v] > 1
        split = np.flatnonzero(hot)
        name[split] = mix(name[split] + (hashes[u[split]] % classes[v[split]].astype(np.uint64)) + np.uint64(1))
        del split
        shard = ((name >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable").astype(np.int32)
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        del shard
        marked = np.repeat(np.arange(len(n), dtype=np.int32) * 2 + np.array(row["train"], np.int32), n)
        for s, some in ((s, some) for s in range(shards) for some in (False, True)):
            at = order[ends[s]:ends[s + 1]]
            at = at[hot[at] == some]
            if len(at):
                names, place, vi = np.unique(name[at] >> SHORT, return_index=True, return_inverse=True)
                both = np.concatenate([u[at], number[at]])
                words, one, uw = np.unique(hashes[both] >> SHORT, return_index=True, return_inverse=True)
                out.append(dict(shard=s, block=row["block"], all=every, kinds=kinds, hot=squeeze(hashes[v[at[place]]] >> SHORT) if some else None, v=squeeze_hashes(names), vi=squeeze(vi), w=squeeze_hashes(words), c=squeeze(count[both[one]]),
                                ui=squeeze(uw[:len(at)]), wi=squeeze(uw[len(at):]), doc=squeeze(np.diff(marked[at], prepend=0))))
        return pa.Table.from_arrays([pa.array([r["ids"].values.to_pylist() if f.name == "ids" and "ids" in r else r.get(f.name) for r in out], f.type) for f in schema], schema=schema)

    return run


def score_range(v: np.ndarray, u: np.ndarray, w: np.ndarray, train: np.ndarray, base: np.ndarray, logs: np.ndarray, n_v: int, discount: float, spread: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """log10 P of every trigram occurrence of some middle words, by a trie of the training ones among them; ``spread``: counts of
    pairs whose middle word has classes elsewhere too (``Trie.image``)."""
    width = len(base)
    context, ctx = np.unique(v.astype(np.int64) * width + u, return_inverse=True)
    triple, same = np.unique(ctx * width + w, return_inverse=True)
    n = np.bincount(same[train], minlength=len(triple))
    k = np.flatnonzero(n)
    at, cw = np.divmod(triple[k], width)
    cv, cu = np.divmod(context[at], width)
    trie = Trie.mapped(Trie.image(cv, cu, cw, n[k], base, n_v, width, discount, spread))
    p = np.empty(len(triple))
    for lo in range(0, len(triple), QUERIES):
        at, cw = np.divmod(triple[lo:lo + QUERIES], width)
        p[lo:lo + QUERIES] = trie.query(*np.divmod(context[at], width), cw, logs[cw])
    return p[same]


def trigrams(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """(names, words, place in w_all of each row's words, v, u, w, documents by row, training) of a shard's trigrams; v is a place in names."""
    vs, ws = [expand_hashes(r["v"]) for r in rows], [expand_hashes(r["w"]) for r in rows]
    v_all, w_all = np.unique(np.concatenate(vs)), np.unique(np.concatenate(ws))
    at = [np.searchsorted(w_all, w) for w in ws]
    v = np.concatenate([np.searchsorted(v_all, x).astype(np.int32)[expand(r["vi"])] for x, r in zip(vs, rows)])
    u = np.concatenate([a.astype(np.int32)[expand(r["ui"])] for a, r in zip(at, rows)])
    w = np.concatenate([a.astype(np.int32)[expand(r["wi"])] for a, r in zip(at, rows)])
    docs = [np.cumsum(expand(r["doc"])) for r in rows]
    return v_all, w_all, at, v, u, w, docs, np.concatenate([d & 1 for d in docs]).astype(bool)


def tally(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """(name, middle word, w, before) of the pairs that a shard's hot rows hold, asked for or learned: ``before`` different words
    stand before the pair in training documents of this class of the middle word."""
    v_all, w_all, _, v, u, w, _, train = trigrams(rows)
    word = np.zeros(len(v_all), np.int64)
    for r in rows:
        word[np.searchsorted(v_all, expand_hashes(r["v"]))] = expand(r["hot"])
    width = len(w_all)
    pairs, pair = np.unique(v.astype(np.int64) * width + w, return_inverse=True)
    learned = np.unique(pair[train] * width + u[train]) // width
    at, pw = np.divmod(pairs, width)
    return v_all[at].astype(np.int64), word[at], w_all[pw].astype(np.int64), np.bincount(learned, minlength=len(pairs))


def score_shard(rows: list[dict], discount: float, spread: tuple[np.ndarray, ...] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, documents, sums of log10 P) of a shard: learn from the trigrams of training documents, query all distinct ones.
    ``spread``: (name, w, before, mass, degree) of pairs with a hot middle word, over all its classes."""
    v_all, w_all, at, v, u, w, docs, train = trigrams(rows)
    c = np.zeros(len(w_all), np.int64)
    for a, r in zip(at, rows):
        c[a] = expand(r["c"])
    base = (c + 0.1) / (rows[0]["all"] + 0.1 * (rows[0]["kinds"] + 1))
    del at
    if spread is not None:
        hv, hw = np.searchsorted(v_all, spread[0]), np.searchsorted(w_all, spread[1])
        by = np.argsort(hv, kind="stable")
        hv, hw, *sums = (x[by] for x in (hv, hw, *spread[2:]))
    p, logs = np.empty(len(v)), np.log10(base)
    order = np.argsort(v, kind="stable").astype(np.int32)
    starts = np.searchsorted(v[order], np.arange(len(v_all) + 1))
    low = 0
    while low < len(v_all):         # a trie for every range of middle words: all that is known of a word lies together
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + TRIE_TOKENS, "right")) - 1)
        mine = order[starts[low]:starts[high]]
        whole = None
        if spread is not None:
            i, j = np.searchsorted(hv, [low, high])
            whole = (hv[i:j] - low, hw[i:j], *(x[i:j] for x in sums))
        p[mine] = score_range(v[mine] - low, u[mine], w[mine], train[mine], base, logs, high - low, discount, whole)
        low = high
    lo = 0
    for r, d in zip(rows, docs):
        d = d >> 1
        total = np.bincount(d, p[lo:lo + len(d)])
        here = np.unique(d)
        yield r["block"], here, total[here]
        lo += len(d)


def score(docs: DataFrame, folds: int = 10, discount: float = DISCOUNT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    An interpolated Kneser-Ney trigram model of the documents whose id's crc32 leaves a remainder other than 0 by ``folds``
    scores every document, held-out ones included. Nothing passes through the driver and no vocabulary is broadcast: documents
    travel in blocks with their own word lists, corpus counts return to blocks range by range, and trigrams are dealt to shards
    by their middle word, so that a shard holds every count its probabilities need. Each shard builds its Elias-Fano trie,
    queries it once for each distinct trigram, and returns sums per document. A middle word with over HOT_COUNT tokens and
    1/4096 of all is dealt in classes by the word before it, so that no shard grows with a hot word. A class holds all that its
    trigrams' own counts need; how many words stand before a pair is summed over the classes first and returns to each of them,
    so scores are those of the undivided word.

    Null, empty and blank texts are the end token alone; a null id counts as the empty text in the split; repeated rows are
    scored (and learned) each; an empty table gives no rows; further columns of the input are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.select(F.col(key).alias("k")).dtypes[0][1]
    data = blocks(docs, key, text, folds).repartition(parts, "block")
    back = counts(data, parts).repartition(parts, "block")
    sent_schema = spark.createDataFrame([], _SENT.format(kind)).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow, arrow_back = to_arrow_schema(sent_schema), to_arrow_schema(spark.createDataFrame([], _BACK.format(kind)).schema)
    sent = data.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_send(parts, arrow), sent_schema)
    passing = ("ids", "held", "n", "known", "base", "all")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for b in batches:
            for r in b.filter(b["hot"].is_valid()).drop_columns(["ids", "held", "n", "known", "base"]).to_pylist():
                held[r["shard"]].append(r)
        for s in list(held):
            name, word, w, before = tally(held.pop(s))
            for lo in range(0, len(name), QUERIES):
                yield pa.record_batch([pa.array(np.full(len(name[lo:lo + QUERIES]), s, np.int32)), *(pa.array(x[lo:lo + QUERIES]) for x in (name, word, w, before))], ["shard", "name", "word", "w", "before"])

    def work(rows: pa.Table, spread: pa.Table) -> pa.Table:
        home = rows["ids"].is_valid()
        keep = rows.filter(home)
        out = [pa.table([keep[f.name] if f.name in ("block", "shard", *passing) else pa.nulls(keep.num_rows, f.type) for f in arrow_back], schema=arrow_back)]
        rest = sorted(rows.filter(pa.compute.invert(home)).drop_columns(["ids", "held", "n", "known", "base"]).to_pylist(), key=lambda r: (r["block"], r["hot"] is not None))
        sums = tuple(spread[c].to_numpy() for c in ("name", "w", "before", "mass", "degree")) if spread.num_rows else None
        for block, d, p in score_shard(rest, discount, sums) if rest else ():
            out.append(pa.table([pa.array([{"block": block, "shard": rest[0]["shard"], "doc": squeeze(d), "score": p.tobytes()}.get(f.name)], f.type) for f in arrow_back], schema=arrow_back))
        return pa.concat_tables(out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, sums = {}, defaultdict(list)
        for b in batches:
            valid = b["ids"].is_valid().to_pylist()
            for i, home in enumerate(valid):
                block = b["block"][i].as_py()
                if home:
                    homes[block] = b.slice(i, 1)
                else:
                    sums[block].append((b["shard"][i].as_py(), b["doc"][i].as_py(), b["score"][i].as_py()))
        for block, row in homes.items():
            n = row["n"].flatten()
            total = np.zeros(len(n))
            for _, d, p in sorted(sums.pop(block, [])):             # in one order: equal sums on every run
                total[expand(d)] += np.frombuffer(p)
            yield pa.record_batch([row["ids"].flatten(), row["held"].flatten(), n, row["known"].flatten(), pa.array([row["all"][0].as_py()] * len(n), pa.int64()), row["base"].flatten(), pa.array(total)],
                                  ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # words before a pair with a hot middle word: counted in its classes, summed, and back to the classes that hold the pair
    dealt = sent.repartition(parts, "shard")
    hot = dealt.mapInArrow(pairs, "shard int, name long, word long, w long, before long")
    whole = hot.groupBy("word", "w").agg(F.sum("before").alias("before"), F.collect_list(F.struct("shard", "name")).alias("classes")).where("before > 0")
    words = whole.groupBy("word").agg(F.sum("before").alias("mass"), F.count(F.lit(1)).alias("degree"))
    spread = whole.join(words, "word").select(F.explode("classes").alias("at"), "w", "before", "mass", "degree").select("at.shard", "at.name", "w", "before", "mass", "degree")
    scored = dealt.groupBy("shard").cogroup(spread.repartition(parts, "shard").groupBy("shard")).applyInArrow(work, _BACK.format(kind))
    # documents that stay by while their trigrams travel are found again by their block
    return (scored.repartition(parts, "block")
            .mapInArrow(gather, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("k", key))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
