"""Resampling, the filter audit and byte-level BPE against plain versions of themselves."""
import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import re

from tests.llm.helpers import DOCS, LOWER, edge, empty, prose, rows, words
from tickloom.llm import blocks, byte_bpe, filter_audit, resampling
from tickloom.llm.common import table


# ---- resampling ----

def features_of(text, grams):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i:i + g]) for g in range(1, grams + 1) for i in range(len(w) - g + 1)]


def brute_resample(docs, target, percent=10, grams=1, buckets=10_000, least=20, seed=2024):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (np.bincount([of(f) for x in texts for f in features_of(x, grams)[1]], minlength=buckets).astype(float) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in docs:
        w, f = features_of(x, grams)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(y)] for y in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    n = percent * len(able) // 100
    return Counter((*r[:4], i + 1) for i, r in enumerate(able[:n])) + Counter((*r[:4], None) for r in able[n:] + [r for r in out if not r[4]])


def test_resampling_is_that_of_all_rows_at_once(spark, tiny, monkeypatch):
    monkeypatch.setattr(resampling, "PIVOTS", 3)          # several rounds of the search
    bench = pd.read_parquet(f"{tiny}/benchmark.parquet").text.tolist()
    docs = table(spark, tiny, "documents")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    for percent, grams in ((10, 1), (37, 3), (0, 1)):
        got = resampling.resample(docs, table(spark, tiny, "benchmark"), percent=percent, grams=grams).collect()
        assert Counter(map(tuple, got)) == brute_resample(plain, bench, percent, grams)


def test_resampling_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PIVOTS", 2)
    more = rows() + [rows()[0]] * 9 + [(None, prose(8), "en", "hot", 1, None, None, None)] * 5
    docs = spark.createDataFrame(more, DOCS).repartition(3)
    target = spark.createDataFrame([(prose(2, 30),), (None,), ("",)], "text string")
    for percent in (25, 60, 100):
        got = resampling.resample(docs, target, percent=percent, buckets=97).collect()
        assert Counter(map(tuple, got)) == brute_resample([(r[0], r[1]) for r in more], [prose(2, 30)], percent, buckets=97)
    assert resampling.resample(empty(spark), target).count() == 0
    none = resampling.resample(docs, target.limit(0), buckets=97).collect()
    assert Counter(map(tuple, none)) == brute_resample([(r[0], r[1]) for r in more], [], buckets=97)
    names = docs.withColumnsRenamed({"k": "weight", "t": "rank", "score": "n_features"})
    assert resampling.resample(names, target, buckets=97).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_runs_of_words_cross_pieces(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 11)
    text = "Ab1 c-d été\x00straße " + "x" * 40 + " Zz9 AAAAAAAAAAAAAAAAAAAA b"
    for grams in (1, 2, 4):
        got = list(resampling.word_runs(text.encode(), grams))
        assert sum(n for n, _ in got) == len(features_of(text, 1)[0])
        assert Counter(f.decode() for _, fs in got for f in fs) == Counter(features_of(text, grams)[1])


# ---- filter audit ----

def brute_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[c] == 1} for c in (0, 1))
    seen = {}
    for i, t, _ in docs:
        if i is not None:
            seen[t or ""] = min(i, seen.get(t or "", i))
    flags = []
    for i, t, s in docs:
        t = t or ""
        w = words(t, lower=False)
        flags.append((s or "", i, {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                                   "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and seen[t] < i}))
    out = {}
    for part in {f[0] for f in flags}:
        mine, shares = [f[1:] for f in flags if f[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [i for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                failing = [f for _, f in mine if f[x]]
                shares[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(f.values()) == 1 for f in failing), sum(i in good for i in gone), sum(i in toxic for i in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shares[order[step - 1]])
    return out


def by_step(df):
    got = df.collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(out) == len(got)
    return out


def test_audit_counts_every_order(spark, tiny, monkeypatch):
    docs, labels = table(spark, tiny, "documents"), table(spark, tiny, "labels")
    want = brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], labels.collect())
    assert by_step(filter_audit.audit(docs, labels)) == want
    monkeypatch.setattr(blocks, "BLOCK", 20_000)          # many blocks meet in the dictionary
    monkeypatch.setattr(filter_audit, "PIECE", 100)
    assert by_step(filter_audit.audit(docs, labels)) == want


def test_audit_of_awkward_rows(spark):
    more = rows() + [(50, "$A " * 60, "en", None, 1, None, None, None), (51, "$A " * 60, "en", "", 1, None, None, None), (52, "Ünï " * 60, "en", "hot", 1, None, None, None)]
    marks = [(0, 1, 0), (1, 0, 1), (3, 1, 1), (3, 0, 0), (4, 1, 0), (None, 1, 1), (51, 1, 1), (900, 1, 1)]
    docs = spark.createDataFrame(more, DOCS.replace(" k string", " quality string").replace(" t string", " toxic string")).repartition(3)
    labels = spark.createDataFrame(marks, "doc_id int, quality int, toxic int")
    assert by_step(filter_audit.audit(docs, labels)) == brute_audit([(r[0], r[1], r[3]) for r in more], marks)
    assert filter_audit.audit(empty(spark), labels).count() == 0
    assert by_step(filter_audit.audit(docs, labels.limit(0))) == brute_audit([(r[0], r[1], r[3]) for r in more], [])


def test_the_matrix_is_whole_and_its_dictionary_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 300)
    dictionary, shards = filter_audit.term_matrix(edge(spark))
    names = {r.term_id: r.word for r in dictionary.collect()}
    assert sorted(names) == list(range(len(names))) and len(set(names.values())) == len(names)
    got = []
    for s in shards.collect():
        for i, k in enumerate(s.k):
            lo, hi = s.indptr[i], s.indptr[i + 1]
            got.append((k, tuple(sorted((names[t], n) for t, n in zip(s.indices[lo:hi], s.data[lo:hi])))))
    assert Counter(got) == Counter((r[0], tuple(sorted(Counter(words(r[1], lower=False)).items()))) for r in rows())


# ---- byte-level BPE ----

@pytest.fixture(scope="module")
def library():
    import tiktoken
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encodes_and_decodes_as_the_library(spark, tiny, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK", 50_000)
    monkeypatch.setattr(byte_bpe, "WORDS", 700)
    monkeypatch.setattr(byte_bpe, "KNOWN", 3000)
    docs = table(spark, tiny, "documents").select("doc_id", "text").union(spark.createDataFrame(rows(), DOCS).select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(900, "a" * 3000 + "\n" * 999 + " \t x'll 12　é中" * 20), (901, "<|endoftext|>")], "doc_id long, text string"))
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.data)) for r in got) == want
    few = byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(docs.where("doc_id >= 900")))).collect()
    ids = {r.doc_id: np.array(library.encode_ordinary(r.text or ""), "<u4") for r in docs.where("doc_id >= 900").collect()}
    assert all((r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(ids[r.doc_id].tobytes()).hexdigest()) for r in few)


def test_tokens_of_awkward_tables(spark):
    assert byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(empty(spark)))).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, None)], DOCS.split(", lang")[0])
    got = byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(nothing))).collect()
    blank = hashlib.sha256(b"").hexdigest()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {(i, 0, blank, blank) for i in (1, 2, None)}
    with pytest.raises(Exception):
        byte_bpe.decode(spark.createDataFrame([([70_000],)], "ids array<int>")).collect()


def plain_bpe(word, ids):
    """The lowest rank first, of equal ones the left one, until no pair is a token."""
    if word in ids:
        return [ids[word]]
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        found = [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
        if not found:
            return [ids[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_replay_with_ranks_in_any_order(tmp_path):
    """Ranks that are no training order: joining may make a pair that comes before those that wait."""
    r = random.Random(3)
    for turn in range(30):
        tokens = {bytes([b]) for b in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(40)}
        order = sorted(tokens)
        r.shuffle(order)
        path = tmp_path / f"ranks-{turn}"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(order)))
        v = byte_bpe.Vocabulary(str(path))
        some = [bytes(r.choice(b"abcd") for _ in range(r.randint(1, 25))) for _ in range(200)] + [b"a" * 50]
        flat, bounds = byte_bpe.replay(some, v)
        assert [flat[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == [plain_bpe(w, v.ids) for w in some]


def test_words_of_pieces(monkeypatch, library):
    import regex
    monkeypatch.setattr(byte_bpe, "PIECE", 40)
    text = " ".join([prose(3, 300), "a  b", "c\n\n d", "'s it's", "12 34 5a", "é é", "x" * 500, " ", "end "])
    assert [w for part in byte_bpe.words_of(text, byte_bpe.splitter()) for w in part] == regex.findall(public_tokenizers.PATTERN, text)
