"""Quality rules as weak supervision: rules vote or abstain, EM weighs them (op 6, DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import UPPER, let, stored, table, words_of

#: Symbols counted by ``n_symbols``.
SYMBOLS = "#*$%&|<>"


def without(text: Column, chars: str) -> Column:
    """Length of a text without some ASCII characters; searching for single bytes is far cheaper than mapping every character."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text)


def covered(windows: Column, width: int) -> Column:
    """How many words lie in a window whose hash is found at two places or more."""
    def starts(pairs):
        n = F.size(pairs)
        alike = lambda i, j: (j >= 0) & (j < n) & (F.get(pairs, i)["x"] == F.get(pairs, j)["x"])
        hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: alike(i, i - 1) | alike(i, i + 1))
        return F.sort_array(F.transform(hits, lambda i: F.get(pairs, i)["i"]))

    def total(at):
        steps = F.transform(F.slice(at, F.lit(2), F.size(at) - 1), lambda x, i: F.least(F.lit(width), x - F.get(at, i)))
        return F.aggregate(steps, F.lit(width), lambda s, x: s + x)

    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(pairs, starts), total)).otherwise(0)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, n_stops."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def counts(w):
        at = lambda i, k: F.get(w, i + k)
        hashes = F.when(F.size(w) >= 6, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)])))
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.coalesce(let(hashes, lambda h: covered(h, 5)), F.lit(0)).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    rows = docs.select(
        F.col(key).alias(key), let(words_of(t), counts).alias("c"), F.length(t).alias("n"), without(t, SYMBOLS).alias("no_symbols"),
        without(t, " \t\n\x0b\x0c\r").cast("long").alias("word_chars"), without(t, "!").alias("no_marks"), F.length(F.translate(t, UPPER, "")).alias("no_upper"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return rows.select(key, "c.n_words", "word_chars", (F.col("n") - F.col("no_symbols")).cast("long").alias("n_symbols"), "n_dup_lines",
                       "c.n_repeat_words", (F.col("n") - F.col("no_upper")).cast("long").alias("n_upper"), (F.col("n") - F.col("no_marks")).cast("long").alias("n_marks"))


def vote(bad: str, good: str) -> str:
    """SQL: -1 where the rule finds low quality, 1 where it finds quality, 0 where it abstains."""
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


#: The rules by name; each is a few comparisons over the counts. Texts without words make all but the first abstain.
RULES = {
    "length": vote("n_words < 10", "n_words >= 40"),
    "word_size": vote("n_words >= 10 AND (word_chars < 2.5 * n_words OR word_chars > 12 * n_words)", "n_words >= 10 AND word_chars BETWEEN 3.5 * n_words AND 9 * n_words"),
    "symbols": vote("n_words > 0 AND 10 * n_symbols > n_words", "n_words > 0 AND 50 * n_symbols <= n_words"),
    "dup_lines": vote("n_dup_lines >= 5", "n_words > 0 AND n_dup_lines = 0"),
    "repeats": vote("n_words > 0 AND 100 * n_repeat_words > 20 * n_words", "n_words > 0 AND 100 * n_repeat_words <= 5 * n_words"),
    "upper": vote("n_words > 0 AND 10 * n_upper > 3 * word_chars", "n_words > 0 AND 20 * n_upper <= 3 * word_chars"),
    "marks": vote("n_words > 0 AND 5 * n_marks > n_words", "n_words > 0 AND 50 * n_marks <= n_words"),
}


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """EM over counts of vote patterns: the share of good texts, and for each rule how often its votes are right on good and on
    low-quality texts. An abstention says nothing. Beta(8, 2) priors keep a rule that hardly votes near 0.8.

    ``patterns`` has at most 3 ** rules entries however large the corpus is; an empty corpus gives the priors.
    """
    width = len(patterns[0][0]) if patterns else 0
    prior, rates = 0.8, [(0.8, 0.8)] * width
    for _ in range(rounds if patterns else 0):
        good = [(v, n, n * posterior(v, prior, rates)) for v, n in patterns]
        total, yes = sum(n for _, n, _ in good), sum(g for *_, g in good)
        prior = (yes + 8) / (total + 10)
        rates = [((sum(g for v, _, g in good if v[j] > 0) + 8) / (sum(g for v, _, g in good if v[j]) + 10),
                  (sum(n - g for v, n, g in good if v[j] < 0) + 8) / (sum(n - g for v, n, g in good if v[j]) + 10)) for j in range(width)]
    return prior, rates


def log_odds(v: int, right_good: float, right_bad: float) -> float:
    return 0.0 if v == 0 else math.log(right_good / (1 - right_bad)) if v > 0 else math.log((1 - right_good) / right_bad)


def posterior(votes: tuple[int, ...], prior: float, rates: list[tuple[float, float]]) -> float:
    return 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(log_odds(v, *r) for v, r in zip(votes, rates))))


def supervise(docs: DataFrame, rules: dict[str, str] | None = None, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the counts, base_failed, ``quality`` (posterior probability) and kept.

    The counts are computed once, into the shared folder. EM reads only the number of documents with each pattern of votes, and
    its result returns as one expression over the votes. Null, empty and blank texts have no words and fail the base rule;
    repeated rows are judged alike, each once; an empty table gives no rows; further columns of the input are ignored.
    """
    rules = {name: F.expr(sql) for name, sql in (RULES if rules is None else rules).items()}
    rows = stored(features(docs, key, text), "quality-counts")
    seen = rows.groupBy(*[c.alias(f"v_{name}") for name, c in rules.items()]).agg(F.count(F.lit(1)).alias("n")).collect()   # <= 3 ** rules
    prior, rates = fit(sorted((tuple(int(x) for x in r[:-1]), r["n"]) for r in seen))
    odds = F.lit(math.log(prior / (1 - prior)))
    for c, r in zip(rules.values(), rates):
        odds = odds + F.when(c > 0, F.lit(log_odds(1, *r))).when(c < 0, F.lit(log_odds(-1, *r))).otherwise(0.0)
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    quality = 1 / (1 + F.exp(-odds))
    return rows.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       quality.alias("quality"), (~failed & (quality >= threshold)).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervise(table(spark, sf_dir, "documents"))
