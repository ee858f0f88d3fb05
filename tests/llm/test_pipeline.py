"""The pipeline stage by stage, each judged on its own input, and without the subpackage."""
import collections
import itertools
import os
import random
import shutil
import subprocess
import sys

import pandas as pd

import corpus_pipeline
from tests.llm.helpers import DOCS, prose, rows, shingles, words
from tests.llm.test_duplicates import brute_leaks, check_near, roots
from tests.llm.test_text_models import check_pieces
from tickloom.llm import byte_cnn
from tickloom.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return collections.Counter(-1 if pd.isna(i) else int(i) for i in df.doc_id)


def test_stages_on_the_table(spark, tiny):
    docs = table(spark, tiny, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "packing"]
    frames = [docs]
    for name in list(stages)[:-1]:
        frames.append(stored(stages[name](spark, frames[-1], tiny), "stage"))
        assert frames[-1].columns == COLUMNS and frames[-1].dtypes == docs.dtypes
    raw, good, lined, single, clean = (f.toPandas() for f in frames)
    scores = byte_cnn.classify(docs, table(spark, tiny, "labels")).toPandas().set_index("doc_id").score
    assert set(good.doc_id) == set(scores[scores >= corpus_pipeline.THRESHOLD].index)
    gone = set(good.doc_id) - set(lined.doc_id)     # only documents of lines that others have
    by_size = collections.defaultdict(list)
    for i, t in zip(good.doc_id, good.text):
        for x in t.split("\n"):
            by_size[len(words(x, lower=False))].append((i, words(x, lower=False)))
    for i, t in zip(good.doc_id, good.text):
        if i in gone:       # every line has one like it, of the same length and mostly the same words in place
            assert all(any(j != i and 2 * sum(a == b for a, b in zip(w, v)) >= len(w) for j, v in by_size[len(w)]) for w in (words(x, lower=False) for x in t.split("\n")) if w)
    assert ids(lined) == ids(good[~good.doc_id.isin(gone)])
    before = good.set_index("doc_id").text
    assert all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in zip(lined.doc_id, lined.text) if t)
    sets = {i: shingles(t, 5) for i, t in zip(lined.doc_id, lined.text)}
    from tickloom.llm.near_dedup import near_duplicates
    out = near_duplicates(frames[2]).collect()
    check_near(lined[["doc_id", "text"]].values.tolist(), out, 5, 80)
    assert set(single.doc_id) == {r.doc_id for r in out if r.kept} and len(sets) == len(lined)
    bench = pd.read_parquet(f"{tiny}/benchmark.parquet")[["item_id", "text"]].values.tolist()
    leaking = {x[0] for x in brute_leaks(single[["doc_id", "text"]].values.tolist(), bench)}
    assert set(clean.doc_id) == set(single.doc_id) - leaking
    from tickloom.llm.packing import pack
    check_pieces(clean[["doc_id", "text"]].values.tolist(), pack(frames[4]).toPandas(), 2048)
    last = corpus_pipeline.run(spark, tiny).toPandas()
    assert ids(last.drop_duplicates("doc_id")) == ids(clean)


def test_one_document_of_each_group_of_copies_is_packed(spark, tiny, tmp_path):
    """Copies and near copies of the raw table, planted with lines that other documents have too."""
    t = pd.read_parquet(f"{tiny}/documents.parquet")
    long = t[t.text.fillna("").str.count("\n") >= 3].drop_duplicates("text").head(3)
    shared = "\n".join(prose(900, 39).split("\n")[:2])
    new = [t.assign(text=t.text + "\n" + shared)[t.doc_id.isin(long.doc_id[:1])].assign(doc_id=700_000)]
    for k, (_, r) in enumerate(long.iterrows()):
        for j in range(3):      # exact copies of texts made of lines alone, then near copies with one line of their own
            body = "\n".join([r.text, shared] + [prose(950 + k, 120).replace(" ", "\n", 3)])
            new.append(pd.DataFrame([r]).assign(doc_id=800_000 + 10 * k + j, text=body if k < 2 else body + f"\nend {j} of it all"))
    (pa_dir := tmp_path / "in").mkdir()
    for f in ("labels", "benchmark"):
        shutil.copy(f"{tiny}/{f}.parquet", pa_dir / f"{f}.parquet")
    both = pd.concat([t, *new], ignore_index=True)
    both.to_parquet(pa_dir / "documents.parquet")
    sets = {i: s for i, x in both[["doc_id", "text"]].values.tolist() if (s := shingles(x, 5))}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    good = {r.doc_id for r in corpus_pipeline.quality(spark, table(spark, str(pa_dir), "documents"), str(pa_dir)).select("doc_id").collect()}
    root = roots([(a, b) for a, b in links if a in good and b in good], sets)
    sizes = collections.Counter(root[i] for i in sets if i in good)
    assert sum(n > 1 for n in sizes.values()) > 3 and sum(sizes[root[i]] > 1 for i in good if i >= 800_000) >= 6
    last = collections.Counter(root[int(i)] for i in set(corpus_pipeline.run(spark, str(pa_dir)).toPandas().doc_id.dropna()) if int(i) in sets)
    assert set(last.values()) == {1} and set(last) <= set(sizes)


def test_stages_take_awkward_rows_and_empty_tables(spark, tiny):
    for docs in (spark.createDataFrame(rows(), DOCS), spark.createDataFrame([], DOCS)):
        seen = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, tiny), "stage")
            assert docs.columns == DOCS.replace(",", "").split()[::2]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
        assert docs.count() <= seen and out.count() >= docs.count()


def test_a_document_of_lines_that_others_have_goes(spark, tiny):
    a, b, c, own = ([" ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(12)) for _ in range(n)] for r, n in ((random.Random(i), 2 + 4 * (i == 3)) for i in range(4)))
    texts = ["\n".join(a + b), "\n".join(c), "\n".join([a[0], c[1]]), "\n".join([b[1], *own]), "", "\n"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, tiny).collect()}
    assert got == {0: texts[0], 1: texts[1], 3: "\n".join(own), 4: "", 5: "\n"}


def made_lines(seed, n):
    r = random.Random(seed)
    return [" ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(12)) for _ in range(n)]


def test_near_copies_lose_lines_of_earlier_documents(spark, tiny):
    """A group of copies counts as one document: it loses what an earlier one has, keeps what its members share, and stays a group."""
    first, own, late = made_lines(50, 3), made_lines(51, 9), made_lines(52, 2)
    edit = lambda k: " ".join(["zzzzzz", *own[k].split(" ")[1:]])
    texts = [first, [*own, first[1]], [*own[:8], edit(8), first[1]], [*own, first[1]], [own[2], *late], ["Late of its kind", first[2]]]
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lined = stored(corpus_pipeline.lines(spark, docs, tiny), "stage")
    got = {r.doc_id: r.text.split("\n") for r in lined.collect()}
    assert got == {0: first, 1: own, 2: [*own[:8], edit(8)], 3: own, 4: late, 5: ["Late of its kind"]}
    assert {r.doc_id: r.text.split("\n") for r in corpus_pipeline.near(spark, lined, tiny).collect()} == {0: first, 1: own, 4: late, 5: ["Late of its kind"]}


def test_copies_that_line_dedup_would_hide_go(spark, tiny):
    """Of near copies most of whose lines an earlier document has, too little is left to tell them by: the first of them stays, in buckets of any size."""
    shared, ends = made_lines(60, 20), [made_lines(61 + k, 1)[0] for k in range(30)]
    texts = [[*shared[:10], *made_lines(90, 10)], [*shared[10:], *made_lines(91, 10)], *([*shared, e] for e in ends), [made_lines(92, 1)[0], shared[3]]]
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for some, group in ((docs, 30), (docs.where("doc_id < 6 OR doc_id > 31"), 4)):
        got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.lines(spark, some, tiny).collect()}
        assert some.count() == group + 3 and got == {0: texts[0], 1: texts[1], 2: ends[:1], 32: texts[32][:1]}


def test_line_dedup_runs_no_python_and_finds_all_near_copies(spark, tiny, monkeypatch):
    from tickloom.llm import near_dedup
    base = [(r.doc_id, r.text) for r in pd.read_parquet(f"{tiny}/documents.parquet").itertuples()]
    edited = [(900_000 + i, " ".join(w if k % 150 else "changed" for k, w in enumerate((t or "").split(" ")))) for i, t in base[:60]]
    table = [*base, *edited, *((950_000 + i, base[0][1]) for i in range(30)), (None, base[1][1])]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    sets = {i: s for i, t in table if i is not None and (s := shingles(t, 5))}
    want = {x for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for x in (a, b)}
    got = {r.doc_id for r in near_dedup.with_copies(docs).collect()}
    assert len(want) > 80 and want <= got and len(got - want) < 20
    plans = []
    monkeypatch.setattr(near_dedup, "stored", lambda df, name, stays=False: plans.append(df) or stored(df, name, stays))
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name, stays=False: plans.append(df) or stored(df, name, stays))
    from tickloom.llm import line_dedup
    monkeypatch.setattr(line_dedup, "stored", lambda df, name, stays=False: plans.append(df) or stored(df, name, stays))
    plans.append(corpus_pipeline.lines(spark, docs, tiny))
    text = "\n".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert len(plans) > 6 and not any(x in text for x in ("InArrow", "InPandas", "EvalPython"))


def test_passing_tables_go(spark):
    import os
    from tickloom.llm.common import passing
    with passing(spark):
        outer = stored(spark.range(5), "outer")
        with passing(spark):
            gone, kept = stored(spark.range(3), "inner"), stored(spark.range(4), "inner", stays=True)
            paths = [d.inputFiles()[0].removeprefix("file://") for d in (outer, gone, kept)]
        assert [os.path.exists(x) for x in paths] == [True, False, True] and kept.count() == 4
    assert not os.path.exists(paths[0]) and os.path.exists(paths[2])


def test_the_rest_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 280 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
