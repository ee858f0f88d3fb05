"""Line dedup by a fixed-depth log-template tree: recurring templates are dropped after their first document (op 5, DataFrame
functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import SPACE, let, stored, table

#: Leading tokens that make the tree's inner levels, below the level of the token count.
DEPTH = 3
#: Share of equal tokens from which a line belongs to the template that heads its leaf.
ALIKE = 0.5
#: Words with a letter that lines of one template have in common behind the leading tokens, and fields tried as the variable one.
FIXED, FIELDS = 2, 16


def tokens_of(line: Column) -> Column:
    """Tokens of a line with variable ones generalised: whatever holds a digit is ``<*>``."""
    # each step is bound: inside a lambda an expression used twice is computed twice
    return let(F.trim(line, F.lit(SPACE)), lambda bare: let(
        F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>")).otherwise(bare),
        lambda x: F.when(F.length(x) > 0, F.split(x, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))))


def line_keys(text: Column) -> Column:
    """For each line with a word: place (from 0), leaf hash (token count and leading tokens) and hash of the generalised tokens.
    Lines that are variable but for fewer than FIXED words, as rows of numbers, say nothing when generalised: they are left out."""
    def entry(line, i):
        return let(tokens_of(line), lambda w: F.struct(
            i.alias("pos"), F.xxhash64(F.size(w), *[F.get(w, F.lit(k)) for k in range(DEPTH)]).alias("leaf"), F.xxhash64(F.size(w), F.concat_ws(" ", w)).alias("exact"), F.size(w).alias("size"),
            F.when(F.array_contains(w, "<*>"), solid(w) < FIXED).otherwise(F.lit(False)).alias("vague")))
    return F.filter(F.transform(F.split(text, "\n"), entry), lambda e: (e["size"] > 0) & ~e["vague"])


def solid(tokens: Column) -> Column:
    """How many tokens are constant words: no ``<*>``, and with a letter."""
    return F.size(F.filter(tokens, lambda x: (x != "<*>") & x.rlike(r"\p{L}")))


def field_keys(leaf: Column, w: Column) -> Column:
    """Hashes of the line without one field each: a third of the tokens behind the leading ones, at up to FIELDS places. Lines that
    differ within such a field alone share the hash, and by it at least two thirds of these tokens."""
    rest = F.size(w) - DEPTH
    field = F.floor(rest / 3).cast("int")
    step = F.greatest(F.lit(1), F.ceil((rest - field) / (FIELDS - 1)).cast("int"))
    def entry(i):
        before, after = F.slice(w, DEPTH + 1, i), F.slice(w, i + field + DEPTH + 1, F.size(w))
        return F.struct(F.xxhash64(leaf, i, before, after).alias("key"), (solid(before) + solid(after)).alias("solid"))
    made = F.filter(F.transform(F.sequence(F.lit(0), rest - field, step), entry), lambda e: e["solid"] >= FIXED)
    return F.when(rest >= 3, F.transform(made, lambda e: e["key"])).otherwise(F.array().cast("array<bigint>"))


def recurring(docs: DataFrame, min_docs: int = 2, key: str = "doc_id", text: str = "text", strict: bool = False, units: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with kd, dig, t and their other columns; places of lines to drop: kd, dig, drops)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.withColumns({"_t": t, "_kd": F.coalesce(F.col(key).cast("string"), F.lit("")), "_dig": F.xxhash64(t)})
    own = base if units is None else base.join(units.select(F.col(key), F.col("unit").alias("_unit")), key, "left")
    unit = [] if units is None else [F.coalesce("_unit", key).alias("unit"), F.when(F.col("_unit").isNull(), F.col("_dig")).otherwise(0).alias("mark")]
    lines = stored(own.select(F.col(key).alias("k"), "_kd", "_dig", *unit, F.inline(line_keys(F.col("_t")))).drop("vague"), "line-keys")
    # documents without an id come last
    place = F.struct(F.col("k").isNull().alias("none"), F.col("unit" if unit else "k").alias("unit"), F.col("mark" if unit else "_dig").alias("mark"))
    first = F.min(F.struct(place.alias("place"), "k", "_dig"))
    # what is equal in all tokens: one row per line and document, then per line; a hot line is combined before the shuffle
    exact = stored(lines.groupBy("leaf", "exact").agg(first.alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size")), "exact-lines")
    # leaves with several different lines: the most frequent one heads the leaf, those alike join its template
    heads = exact.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "exact"))["exact"].alias("head")).where("kinds > 1").select("leaf", "head")
    shared = stored(exact.select("leaf", "exact").join(heads, "leaf"), "shared-leaves")
    wanted = shared.select("leaf", "exact").distinct()
    # their tokens, from one occurrence of each: only these lines' text is read again
    one = exact.select("leaf", "exact", F.col("first.k").alias("k"), F.col("first._dig").alias("_dig")).join(wanted, ["leaf", "exact"])
    places = lines.select("leaf", "exact", "k", "_dig", "pos").join(one, [lines["leaf"] == one["leaf"], lines["exact"] == one["exact"], lines["k"].eqNullSafe(one["k"]), lines["_dig"] == one["_dig"]], "left_semi")
    spots = places.groupBy("k", "_dig", "leaf", "exact").agg(F.min("pos").alias("pos")).groupBy("k", "_dig").agg(F.collect_list(F.struct("leaf", "exact", "pos")).alias("spots"))
    texts = base.select(F.col(key).alias("k"), "_dig", "_t")
    bodies = (texts.join(spots, [texts["k"].eqNullSafe(spots["k"]), texts["_dig"] == spots["_dig"]])
              .select(F.explode(let(F.split("_t", "\n"), lambda ls: F.transform("spots", lambda s: F.struct(s["leaf"].alias("leaf"), s["exact"].alias("exact"), F.get(ls, s["pos"]).alias("line"))))).alias("x")).select("x.*"))
    bodies = stored(bodies.select("leaf", "exact", tokens_of(F.col("line")).alias("w")).dropDuplicates(["leaf", "exact"]), "leaf-lines")
    led = bodies.join(shared, ["leaf", "exact"])
    top = bodies.join(heads.select("leaf", F.col("head").alias("exact")), ["leaf", "exact"]).select("leaf", F.col("w").alias("h"))
    same = F.size(F.filter(F.zip_with("w", "h", lambda x, y: x == y), lambda x: x))
    alike = same >= F.lit(ALIKE) * F.size("w")
    if strict:
        behind = let(F.filter(F.zip_with(F.slice("w", DEPTH + 1, F.size("w")), F.slice("h", DEPTH + 1, F.size("w")), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()),
                     lambda both: (3 * F.size(both) >= 2 * (F.size("w") - DEPTH)) & (solid(both) >= FIXED))
        alike = (F.col("exact") == F.col("head")) | behind
    met = led.join(top, "leaf").withColumn("alike", alike)
    # the others meet by what is left of them without a field: every template of a leaf is found, however many it has
    fields = stored(met.where("NOT alike").select("leaf", "exact", F.explode(field_keys(F.col("leaf"), F.col("w"))).alias("key")), "line-fields")
    kinds = fields.groupBy("leaf", "key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    chosen = fields.join(kinds, ["leaf", "key"]).groupBy("leaf", "exact").agg(F.max(F.struct("kinds", "key"))["key"].alias("template"))
    joined = stored(met.where("alike").select("leaf", "exact", F.col("head").alias("template")).union(chosen), "joined-lines")
    named = exact.join(joined, ["leaf", "exact"], "left").withColumn("template", F.coalesce("template", "exact"))
    groups = named.groupBy("leaf", "template").agg(F.min("first.place").alias("origin"), F.max("last").alias("last"), F.sum("n").alias("n")).where("origin < last")
    if min_docs > 2:        # how many documents exactly matters only then
        per = lines.join(named.select("leaf", "exact", "template"), ["leaf", "exact"]).groupBy("leaf", "template", place.alias("place")).agg(F.lit(1).alias("one"))
        groups = groups.join(per.groupBy("leaf", "template").count().where(F.col("count") >= min_docs).select("leaf", "template"), ["leaf", "template"])
    doomed = named.select("leaf", "exact", "template").join(groups, ["leaf", "template"]).select("leaf", "exact", "origin")
    drops = lines.join(doomed, ["leaf", "exact"]).where(place > F.col("origin")).groupBy("_kd", "_dig", F.col("k").isNull().alias("_none")).agg(F.collect_set("pos").alias("_drops"))
    return base, drops if units is None else stored(drops, "dropped-lines", stays=True)


def drop_templates(docs: DataFrame, min_docs: int = 2, key: str = "doc_id", text: str = "text", strict: bool = False, units: DataFrame | None = None) -> DataFrame:
    """The documents with recurring lines gone: all input columns, ``text`` without them, n_lines, n_dropped.

    The tree has a level for the number of tokens of a line and one for each of its first three tokens; tokens with digits are
    variable. A leaf's most frequent line heads it; lines with at least half of its tokens in place share its template.
    Of the others those share one that are equal but for one field, a third of the tokens behind the leading three at most, with
    two constant words or more outside it; of several such fields the one that most different lines share counts, then the larger hash.
    With ``strict`` (as op5 and the pipeline have it) lines join the head only by the tokens behind the leading three: two
    thirds of them in place, two constant words at least. Lines with a variable token and fewer than two constant words in all,
    as rows of numbers, are no templates and stay.
    The rest are templates of their own, also lines whose variable words are further apart and that no line equals in all but one field. A template that occurs in ``min_docs`` documents or more stays in the first of them (smallest id, then text
    hash; no id comes last) as often as it occurs there, and is dropped from all others. Lines without words stay.

    ``units`` (key, unit: the key of its first document; unique by key) names documents that count as one, as near copies do: a
    template stays in all of its first unit and is dropped from all others, in place of the first document. The places of dropped
    lines are stored then, so the result may be read several times.

    Only hashes of lines travel and are grouped, combined before the shuffle; text is read again for one occurrence of each
    line in leaves that hold several. Null texts are empty; rows equal in id and text are one document; an empty table gives no
    rows; other columns pass (``n_lines`` and ``n_dropped`` are replaced, and no column may start with an underscore).
    """
    base, drops = recurring(docs, min_docs, key, text, strict, units)
    left = base.withColumn("_none", F.col(key).isNull()).join(drops, ["_kd", "_dig", "_none"], "left")
    lines = F.split("_t", "\n")
    kept = F.when(F.col("_drops").isNull(), F.col("_t")).otherwise(F.array_join(let(F.map_from_arrays("_drops", "_drops"), lambda gone: F.transform(
        F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: ~F.map_contains_key(gone, e["i"])), lambda e: e["x"])), "\n"))
    words = F.size(F.filter(lines, lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0))
    columns = [F.col(c) if c != text else kept.alias(text) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return left.select(*columns, words.cast("long").alias("n_lines"), F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_templates(table(spark, sf_dir, "documents"), strict=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))
