"""Near copies, repeated strings, lines and benchmark items: against brute force."""
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import edge, edited, empty, prose, rows, shingles, words
from tickloom.llm import decontamination, line_dedup, near_dedup, substring_dedup
from tickloom.llm import shingles as S
from tickloom.llm.graph import components
from tickloom.llm.registry import queries


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("aAbB \t\n.É", max_size=30), max_size=12), st.integers(1, 40))
def test_word_hashes_stand_for_words(texts, block):
    keep, S.BLOCK = S.BLOCK, block
    try:
        h, at = S.word_hashes(pa.array(texts, pa.string()))
    finally:
        S.BLOCK = keep
    want = [words(t) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    flat = list(itertools.chain(*want))
    assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist())))
    for width in (1, 3, 5):
        v, b = S.distinct_sets(*S.shingle_hashes(h, at, width))
        assert np.diff(b).tolist() == [len(shingles(t, width)) for t in texts]


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 600)] + [(7, 7)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)]
    got = {x.node: x.root for x in components(spark.createDataFrame([*pairs, (None, 5)], "a long, b long")).collect()}
    want = roots(pairs, {n for p in pairs if p[0] != p[1] for n in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_near(table, out, width, percent):
    sets = {}
    for i, t in table:
        sets.setdefault(i, shingles(t, width))
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    n = collections.Counter(p for ids in by.values() for p in itertools.combinations(sorted(ids), 2))
    links = [p for p, k in n.items() if 100 * k >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - k)]
    want = roots(links, sets)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    return links


def test_near_duplicates_on_the_table(spark, tiny):
    table = pd.read_parquet(f"{tiny}/documents.parquet")[["doc_id", "text"]].values.tolist()
    assert check_near(table, queries()["op3_near_dedup"](spark, tiny).collect(), 3, 85)


def test_near_duplicates_edge_cases(spark):
    out = near_dedup.near_duplicates(edge(spark), 3, 85).collect()
    assert len(out) == len(rows())
    assert {(r.component_id, r.kept) for r in out if r.doc_id is None} == {(None, True)}
    check_near([(r[0], r[1]) for r in rows() if r[0] is not None], [r for r in out if r.doc_id is not None], 3, 85)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Chains in which only neighbours are similar enough, and buckets beyond what is joined in one go."""
    monkeypatch.setattr(near_dedup, "TILE", 8)
    monkeypatch.setattr(near_dedup, "SMALL", 6)
    base, table = prose(11, 150), []
    for k in range(150):
        base = edited(base, 7 * k)
        table.append((k, base))
    star = prose(12, 160)
    table += [(1000 + k, edited(star, k)) for k in range(100)] + [(2000 + k, edited(edited(star, 3 * k), 5 * k + 80)) for k in range(40)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    assert len(check_near(table, near_dedup.near_duplicates(docs, 3, 85).collect(), 3, 85)) > 500


def test_sketches_estimate_similarity_and_merge():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 3000, np.uint64)
    b = np.concatenate([a[:2400], r.integers(0, 1 << 63, 300, np.uint64)])
    regs = near_dedup.sketch(np.concatenate([a, b, np.union1d(a, b)]), np.array([0, 3000, 5700, 9000]))
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    s = near_dedup.similarity(regs[:1], regs[1:2], np.array([3000]), np.array([2700]))[0]
    assert abs(s - 2400 / 3300) < .1
    assert near_dedup.similarity(regs[:1], regs[:1], np.array([3000]), np.array([3000]))[0] > .97


def brute_strings(table, width=100):
    seen, out = set(), {}
    for i, t in sorted(table, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        if i in out and out[i][0] == len(b):
            continue
        cover = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if b[s:s + width] in seen:
                cover[s:s + width] = b"\1" * width
            seen.add(b[s:s + width])
        out[i] = (len(b), sum(cover), sum(1 for j in range(len(b)) if cover[j] and not (j and cover[j - 1])), hashlib.sha256(bytes(c for c, k in zip(b, cover) if not k)).hexdigest())
    return out


def test_repeated_strings_on_the_table(spark, tiny):
    table = pd.read_parquet(f"{tiny}/documents.parquet")[["doc_id", "text"]].values.tolist()
    out = queries()["op10_substring_dedup"](spark, tiny).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_strings(table)


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_repeated_strings_edge_cases(spark, hot, monkeypatch):
    """Also with every leading string so hot that the shuffle compares its windows."""
    table = [(r[0], r[1]) for r in rows() if r[0] is not None]
    docs = edge(spark).where("doc_id IS NOT NULL")
    out = substring_dedup.dedup(docs, hot=hot).collect()
    assert len(out) == len(table)
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out}
    assert got == brute_strings(table)
    for r in out:
        raw = (dict(table)[r.doc_id] or "").encode()
        assert r.kept == b"".join(raw[i:j] for i, j in zip([0, *(s.end for s in r.spans)], [*(s.start for s in r.spans), len(raw)]))
    assert len(substring_dedup.dedup(edge(spark)).collect()) == len(rows())
    assert substring_dedup.dedup(empty(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=2, max_size=40), st.integers(1, 50))
def test_buckets_sort_by_the_bytes(choices, chunk):
    """resolve() against the definition, on texts woven of few different passages."""
    r = random.Random(1)
    parts = ["".join(r.choice("ab c") for _ in range(60)).encode() for _ in range(7)]
    texts = [b"".join(parts[c] for c in choices[i:i + 6]) for i in range(0, len(choices), 6)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    d, p, s, n, h = substring_dedup.anchors(data, bounds, 100)
    assert n.sum() == sum(max(0, len(t) - 99) for t in texts)
    if not len(d):
        return
    segs = [data[i:i + m + 99].tobytes() for i, m in zip(s, n)]
    off = np.cumsum([0, *map(len, segs)])[:-1]
    keep, substring_dedup.CHUNK = substring_dedup.CHUNK, chunk
    try:
        row, lo, hi = substring_dedup.resolve(h, d, d * 0, s - bounds[d], p - s, n, np.frombuffer(b"".join(segs), np.uint8), off, 100)
    finally:
        substring_dedup.CHUNK = keep
    cover = [bytearray(len(t)) for t in texts]
    for r_, a, z in zip(row, lo, hi):
        cover[d[r_]][a:z] = b"\1" * (z - a)
    assert [sum(c) for c in cover] == [brute_strings(list(enumerate(t.decode() for t in texts)))[i][1] for i in range(len(texts))]


def brute_leaks(table, items, width=5, least=.8):
    asked = {i: shingles(t, width) for i, t in items}
    out = set()
    for i, t in table:
        s = shingles(t, width)
        out |= {(i, j, len(q & s), len(q)) for j, q in asked.items() if q and len(q & s) >= least * len(q)}
    return out


def test_leaks_on_the_table(spark, tiny):
    d, b = (pd.read_parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    out = queries()["op8_decontamination"](spark, tiny).collect()
    want = brute_leaks(d[["doc_id", "text"]].values.tolist(), b[["item_id", "text"]].values.tolist())
    assert want and {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in out} == want and len(out) == len(want)


def test_leaks_of_all_sizes_scattered_and_edge_cases(spark):
    item = [(k, prose(200 + k, n)) for k, n in enumerate([5, 9, 30, 33, 70, 150, 600])] + [(7, None), (8, ""), (9, "two words"), (10, prose(230, 40)), (10, prose(231, 40)), (None, prose(232, 30))]
    table = []
    for k, (_, t) in enumerate(item[:7]):
        w = t.split(" ")
        table.append((k, prose(300 + k, 2000) + "\n" + t + "\n" + prose(400 + k, 3000)))
        table.append((20 + k, prose(500, 400) + " " + " ".join(w[:len(w) // 2 + 4]) + " " + prose(501, 500) + " " + " ".join(w[len(w) // 2:]) + " tail"))
        table.append((40 + k, prose(502, 400) + " " + " ".join(w[:len(w) // 3])))
    table += [(r[0], r[1]) for r in rows() if r[0] is None or r[0] > 5]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in table], "doc_id long, text string, n_shared double, item string").repartition(3)
    out = decontamination.leaks(docs, spark.createDataFrame(item, "item_id long, text string")).collect()
    want = set().union(*(brute_leaks(table, [i]) for i in item))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in out} == want and len(want) >= 14
    assert decontamination.leaks(empty(spark), spark.createDataFrame(item, "item_id long, text string")).count() == 0
    assert decontamination.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def brute_lines(table, min_docs=2):
    """(n_lines, dropped places) of each document by the tree's definition."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in table}, key=lambda d: d[:2])
    names = {}
    for d in docs:
        for p, line in enumerate(d[2].split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in words(line, lower=False)]
            if w:
                names.setdefault((len(w), *w[:3]), {}).setdefault(tuple(w), []).append((d, p))
    dropped = collections.defaultdict(set)
    for leaf in names.values():
        heads = sorted(leaf, key=lambda w: -len(leaf[w]))
        assert len(leaf) == 1 or len(leaf[heads[0]]) > len(leaf[heads[1]]), "the fixture leaves the head open"
        groups = collections.defaultdict(list)
        for w, at in leaf.items():
            groups[heads[0] if 2 * sum(x == y for x, y in zip(w, heads[0])) >= len(w) else w] += at
        for at in groups.values():
            first = min((d for d, _ in at), key=lambda d: d[:2])
            if len({d for d, _ in at}) >= min_docs:
                for d, p in at:
                    if d != first:
                        dropped[d].add(p)
    return {d: (sum(bool(words(x)) for x in d[2].split("\n")), dropped[d]) for d in docs}


LOG = [(0, "user 17 logged in from 10.0.0.1\nA story of one day\nend of page"), (1, "user 99 logged in from 10.0.0.7\nAnother tale\n\nend of page\nend of page"),
       (2, "user 5 logged in from home\nuser 3 logged in from 10.1.1.1\nA story of two cats\nA story of one day"), (3, None), (4, ""), (5, " \n\t"), (6, "end of page"),
       (7, "the quick brown fox ran over a hill\nthe quick brown cat sat under my old chair"), (8, "the quick brown fox ran over a hill"), (9, "the quick brown fox ran under a hill")]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_templates(spark, min_docs):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in LOG] + [(0, LOG[0][1], "x", 5)], "doc_id long, text string, n_lines string, leaf int").repartition(3)
    out = line_dedup.drop_templates(docs, min_docs).collect()
    assert len(out) == len(LOG) + 1 and out[0].leaf == 5
    want = {d[1]: (v[0], v[1], d[2]) for d, v in brute_lines(LOG, min_docs).items()}
    for r in out:
        n, gone, text = want[r.doc_id]
        assert (r.n_lines, r.n_dropped) == (n, len(gone)), r
        assert r.text == "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)
    assert line_dedup.drop_templates(empty(spark)).count() == 0
    assert len(line_dedup.drop_templates(edge(spark)).collect()) == len(rows())


def test_a_leaf_has_several_templates(spark):
    names = ["alice", "bob", "carol", "dave"]
    log = [(i, f"12:0{i} 7 INFO connection closed by peer now\n12:1{i} 8 INFO user {n} logged in today\n12:2{i} 9 INFO disk of {n} is full") for i, n in enumerate(names)]
    log += [(9, "1 2 INFO connection closed by peer now\n1 2 INFO something else happened there once")]
    out = {r.doc_id: r for r in line_dedup.drop_templates(spark.createDataFrame(log, "doc_id long, text string").repartition(3)).collect()}
    assert out[0].text == log[0][1] and [out[i].text for i in (1, 2, 3)] == ["", "", ""]
    assert out[9].text == "1 2 INFO something else happened there once"


def test_unrelated_short_lines_and_rows_of_numbers_stay(spark):
    log = [(0, "The price of oil rose\n12.5 3.7 9.1\n1 | 2 | 3\nuser 17 logged in from home"), (1, "The price of gold fell\n1.5 2.5 3.5\n4 | 5 | 6\nuser 3 logged in from work"),
           (2, "The price of tin fell\n7.5 8.5 9.5\nPage 2\nHe went to the old house in the woods"), (3, "The price of oil rose\nPage 3\nHe went to my new shop in a city\nuser 5 logged in from 10.0.0.1")]
    docs = spark.createDataFrame(log, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.drop_templates(docs, strict=True).collect()}
    gone = {i: [x for x in t.split("\n") if x not in out[i]] for i, t in log}
    assert gone == {0: [], 1: ["user 3 logged in from work"], 2: [], 3: ["The price of oil rose", "user 5 logged in from 10.0.0.1"]}


def test_short_items_in_long_documents(spark):
    item = [(k, prose(3000 + k, 5 + k % 5)) for k in range(120)]
    table = [(k, prose(4000 + k, 150) + "\n" + t + "\n" + prose(5000 + k, 170)) for k, (_, t) in enumerate(item)]
    out = decontamination.leaks(spark.createDataFrame(table, "doc_id long, text string").repartition(3), spark.createDataFrame(item, "item_id long, text string")).collect()
    want = brute_leaks(table, item)
    assert len(want) >= 120 and {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in out} == want
