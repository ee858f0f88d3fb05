"""Secret scan with corpus-wide ownership: which candidates are widely copied examples, which belong to one owner (op 7)."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stored, table

#: Fixed patterns of the query, in the order in which kinds are listed; keywords count in either case, ASCII letters only.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "owned")
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: A free-standing credential-like word: letters and digits mixed, no sentence punctuation.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, leftmost and non-overlapping per kind; what is too short is dropped after matching."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def bits(word: str) -> float:
    """Shannon entropy per character."""
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def candidates(text: str, spans: list[tuple[int, int, int]], least_bits: float) -> list[tuple[int, int, str]]:
    """(start, end, value) of everything that may be a credential: the base spans' values and opaque words of high entropy."""
    out = []
    for start, kind, end in spans:
        value = text[start:end]
        out.append((start, end, ASSIGN.match(value)[2] if kind == 0 else value))
    for m in OPAQUE.finditer(text):
        w = m[0]
        if re.search("[0-9]", w) and re.search("[A-Za-z]", w) and bits(w) >= least_bits:
            out.append((m.start(), m.end(), w))
    return out


def listing(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "lang",
         max_owners: int = 1, max_repos: int = 3, least_bits: float = 3.5) -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base_sha256, spans, n_examples, n_owned.

    Every candidate value is hashed and counted over the corpus by distinct repositories (owner and ``repo`` together) and
    distinct owners. A value held by at most ``max_owners`` owners and ``max_repos`` repositories looks live: where no base
    span covers it, it joins ``spans`` with kind ``owned``. A value seen with more of them is a widely copied example:
    counted in ``n_examples``, never added; base spans stay either way.

    Counting takes two map-side combined steps, first one row per (value, owner, repository), so that an example that a third
    of all documents quote costs its few distinct repositories. Rows without candidates take no part in the joins' work.

    Null texts are empty; null owners and repositories count as one unnamed owner; repeated rows get equal results; an empty
    table gives no rows; further columns of the input are ignored.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
                       F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("o"), F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("r"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b["t"].to_pylist():
                spans = base_spans(t)
                n = Counter(k for _, k, _ in spans)
                out.append((n[0], n[1], n[2], hashlib.sha256(listing(spans).encode()).hexdigest(), [list(x) for x in spans],
                            [{"s": s, "e": e, "h": hashlib.sha256(v.encode()).hexdigest()} for s, e, v in candidates(t, spans, least_bits)],
                            hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()))
            cols = list(zip(*out)) or [[]] * 7
            yield pa.record_batch([b["k"], b["o"], b["r"], *(pa.array(c, f.type) for c, f in zip(cols, kinds))], names)

    kinds = [pa.field("n_assign", pa.int64()), pa.field("n_access", pa.int64()), pa.field("n_hex", pa.int64()), pa.field("base_sha256", pa.string()),
             pa.field("base", pa.list_(pa.list_(pa.int64()))),
             pa.field("cands", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("h", pa.string())]))), pa.field("text_md5", pa.string())]
    names = ["k", "o", "r", *(f.name for f in kinds)]
    kind = dict(rows.dtypes)["k"]
    found = rows.mapInArrow(look, f"k {kind}, o string, r string, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                  "base array<array<bigint>>, cands array<struct<s:bigint,e:bigint,h:string>>, text_md5 string")
    found = stored(found, "secret-candidates")
    held = found.where(F.size("cands") > 0)
    values = (held.select("o", "r", F.explode("cands.h").alias("h")).groupBy("h", "o", "r").agg(F.lit(1).alias("one"))
              .groupBy("h").agg(F.countDistinct("o").alias("owners"), F.count(F.lit(1)).alias("repos")))
    # equal rows get equal answers, so one of each is judged
    same = ["k", "o", "r", "text_md5"]
    one = held.groupBy(*same).agg(F.first("cands").alias("cands"))
    verdicts = (one.select(*same, F.inline("cands")).join(values, "h")
                .withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
                .groupBy(*same).agg(F.collect_list(F.when(F.col("live"), F.struct("s", "e"))).alias("live"), F.sum((~F.col("live")).cast("long")).alias("n_examples")))
    # rows without candidates are kept out of the join, whose key would put nothing together
    bare = found.where(F.size("cands") == 0).select("k", "n_assign", "n_access", "n_hex", "base_sha256", "base",
                                                    F.array().cast("array<struct<s:bigint,e:bigint>>").alias("live"), F.lit(0).cast("long").alias("n_examples"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]
    full = held.alias("a").join(verdicts.alias("b"), on, "left").select("a.k", "n_assign", "n_access", "n_hex", "base_sha256", "base", "live", F.coalesce("n_examples", F.lit(0)).alias("n_examples"))
    everything = full.unionByName(bare)
    free = lambda x: ~F.exists("base", lambda b: (b[0] < x["e"]) & (x["s"] < b[2]))
    added = F.transform(F.array_distinct(F.filter(F.coalesce("live", F.array().cast("array<struct<s:bigint,e:bigint>>")), free)),
                        lambda x: F.array(x["s"], F.lit(3).cast("long"), x["e"]))
    spans = F.array_join(F.transform(F.sort_array(F.concat("base", added)), lambda x: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), (x[1] + 1).cast("int")), x[0].cast("string"), x[2].cast("string"))), ",")
    return everything.select(F.col("k").alias(key), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), "n_examples", F.size(added).cast("long").alias("n_owned"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
