"""Benchmark decontamination by canonical templates, in DataFrame functions alone.

Numbers (in digits or words), names (a run of them is one) and units become typed placeholders, so a question
with other values has the same template. Windows of five template tokens are hashed and joined with those of
the benchmark; an item of fewer tokens is one window of its own length, and an item of placeholders alone is
looked for by its values. What matches is judged by
occurrence, that is by where in the document the item would begin: what fills its slots must agree there (a
value of the item stands for one value in this occurrence wherever it recurs). An item is found in a document
whose agreeing occurrences hold half of its distinct windows or more,
hold a run of 13 of its tokens in one alignment (shorter items: all of it), or hold most of its words in
one place with few edits between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 5
#: Share of an item's distinct windows that a document must hold, and share of slots that must agree.
COVERAGE, AGREEMENT = 0.5, 0.8
#: Tokens in a row that tell an item whatever its length, and share of its words in one place that does.
RUN, WORDS = 13, 0.8
#: A window of placeholders alone says nothing: it needs this many literal tokens (shorter windows: one for each token).
LITERALS = 2
#: Benchmark windows that are broadcast at most (24 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Units that count as such after a number.
UNITS = "kg g mg km m cm mm mi ft in lb lbs oz l ml s sec min h hr hours minutes seconds days weeks months years percent usd eur dollars euros cents miles meters metres kilometers kilometres grams kilograms pounds feet inches liters litres".split()
#: Number words.
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = ["zero", *ONES, *"ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), *TENS, *(t + o for t in TENS for o in ONES), "hundred", "thousand", "million", "billion"]
#: Marks a name, and stands for the space between the words of one.
NAME, GLUE, NUMBER, UNIT = "\ue000", "\ue001", "#num", "#unit"


def marked_tokens(text: Column) -> Column:
    """Lower-cased words without punctuation. A name (capitalised words of which the first begins no sentence) is one
    token with a mark before it; a unit that is written together with its number is a token of its own."""
    word = r"\p{Lu}\p{Ll}+"
    # What stands before is looked at after the cheap test of a letter or mark, not at every character.
    inner = rf"(\p{{Lu}}(?<=[\p{{Ll}}\p{{N}},;)] \p{{Lu}})\p{{Ll}}+)"
    # Within a marked run of capitalised words every word but the first gets a mark from `inner`, too; it becomes glue.
    within = rf" {NAME}(?<={NAME}\p{{Lu}}\p{{Ll}}{{1,40}} {NAME})(?={word})"
    together = rf"(?<!\S)(\p{{Nd}}+)({'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\S)"

    def clean(t: Column) -> Column:
        # Most texts have no capital inside a sentence, and the test is cheaper than the replacement.
        named = F.when(t.rlike(inner), F.regexp_replace(F.regexp_replace(t, inner, NAME + "$1"), within, GLUE)).otherwise(t)
        line = F.regexp_replace(F.lower(named), rf"[^\p{{L}}\p{{M}}\p{{N}}\s{NAME}{GLUE}]+", "")
        return common.let(line, lambda x: F.filter(F.split(F.when(x.rlike(r"\p{Nd}\p{L}"), F.regexp_replace(x, together, "$1 $2")).otherwise(x), r"\s+"), lambda w: w != ""))

    return common.let(F.translate(F.coalesce(text.cast("string"), F.lit("")), NAME + GLUE, "  "), clean)


def template(tokens: Column) -> Column:
    """Template tokens: marked names, numbers and units after numbers become placeholders."""
    digits, units = r"(?<!\S)\p{Nd}\S*", rf"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?!\S)"

    def names(line: Column) -> Column:
        return F.when(F.contains(line, F.lit(NAME)), F.regexp_replace(line, NAME + r"\S*", "#name")).otherwise(line)

    def numbers(line: Column) -> Column:
        line = F.when(line.rlike(r"\p{Nd}"), F.regexp_replace(line, digits, NUMBER)).otherwise(line)
        return common.let(line, lambda x: F.when(F.contains(x, F.lit(NUMBER)), F.regexp_replace(x, units, UNIT)).otherwise(x))

    # Placeholders hold no space, so positions stay.
    worded = F.transform(tokens, lambda w: F.when(w.isin(NUMBERS), NUMBER).otherwise(w))
    return F.filter(F.split(common.let(common.let(F.array_join(worded, " "), names), numbers), " "), lambda w: w != "")


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _windows(hashes: Column, width: int, salt: int) -> Column:
    """Array of {pos, h}: windows of so many tokens, hashed from the hashes of the tokens."""
    h = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)], *([F.lit(salt)] if salt else []))
    none = F.array().cast("array<struct<pos:int,h:bigint>>")
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.struct(i.alias("pos"), h(i).alias("h")))).otherwise(none)


def _literals(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda w: ~w.startswith("#")))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the items: item_id, wpos, h, width, bare of windows; and item_id, tokens, typed, n_windows (distinct), n_places.

    Windows without literals are left out; an item that has no other is bare, and its windows are of its values.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    items = common.once(common.once(items, "tokens", marked_tokens(F.col("text"))), "typed", template(F.col("tokens")))
    width = F.least(F.size("typed"), F.lit(WINDOW))

    def of(tokens: str, salt: int) -> Column:
        hashes = hashed(F.col(tokens))
        out = _windows(hashes, WINDOW, salt)
        for w in range(1, WINDOW):
            out = F.when(F.size(tokens) == w, _windows(hashes, w, salt)).otherwise(out)
        return out

    told = F.filter(of("typed", 0), lambda x: _literals(F.slice("typed", x.pos + 1, WINDOW)) >= F.least(F.lit(LITERALS), width))
    each = common.once(items, "told", told)
    each = each.select("item_id", width.alias("width"), (F.size("told") == 0).alias("bare"), F.explode(F.when(F.size("told") > 0, F.col("told")).otherwise(of("tokens", 1))).alias("w"))
    each = each.select("item_id", F.col("w.pos").alias("wpos"), F.col("w.h").alias("h"), "width", "bare")
    sizes = each.groupBy("item_id").agg(F.countDistinct("h").alias("n_windows"), F.countDistinct("wpos").alias("n_places"))
    return each, items.select("item_id", "tokens", "typed").join(sizes, "item_id")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, agreement: the items found in each document.

    Windows match anywhere in the whole text and are counted once each. Rows with equal doc_id count as one
    document; rows without doc_id are left out. Null and empty texts and items match nothing. Items with equal
    texts are each found; a short item is found wherever its words stand in a row. Other columns are ignored;
    empty tables give no rows.
    """
    each, items = benchmark_windows(benchmark)
    each = common.cut(spark, each.withColumn("rank", F.dense_rank().over(Window.partitionBy("item_id").orderBy("wpos"))), "benchmark-windows")
    items = common.cut(spark, items, "benchmark-items")
    small = each.count() <= BROADCAST_WINDOWS
    # Documents are cut into windows of other widths, or of values, only if an item asks for them: at most ten rows.
    asked_for = {(r["width"], int(r["bare"])) for r in each.select("width", "bare").distinct().collect()} or {(WINDOW, 0)}
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    typed = common.once(common.once(own, "tokens", marked_tokens(F.col("text"))).select("doc_id", "tokens"), "typed", template(F.col("tokens")))
    for bare, source in ((0, "typed"), (1, "tokens")):
        if any(b == bare for _, b in asked_for):
            typed = common.once(typed, f"hashes{bare}", hashed(F.col(source)))
    cuts = [_windows(F.col(f"hashes{bare}"), width, bare) for width, bare in sorted(asked_for)]
    seen = typed.select("doc_id", F.explode(F.concat(*cuts) if len(cuts) > 1 else cuts[0]).alias("w")).select("doc_id", F.col("w.pos").alias("pos"), F.col("w.h").alias("h"))
    hits = seen.join(F.broadcast(each) if small else each, "h").groupBy("doc_id", "item_id", (F.col("pos") - F.col("wpos")).alias("shift"))
    hits = common.cut(spark, hits.agg(F.collect_set("h").alias("held"), F.sort_array(F.collect_set("rank")).alias("ranks")), "benchmark-hits")
    # What stands at the item's places is read again from the few documents that hold a window of one.
    texts = common.once(own.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), "tokens", marked_tokens(F.col("text"))).select("doc_id", "tokens")
    texts = common.once(texts, "typed", template(F.col("tokens")))
    asked = items.select("item_id", F.col("tokens").alias("given"), F.col("typed").alias("form"), "n_windows", "n_places", F.size("typed").alias("n"))
    lined = texts.join(hits.join(F.broadcast(asked) if small else asked, "item_id"), "doc_id")
    same = F.transform("form", lambda w, i: F.coalesce(F.get("typed", i + F.col("shift")) == w, F.lit(False)))
    lined = common.once(lined, "same", same)
    # A lone equal word between others is chance.
    sure = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("same", i) & ((F.col("n") == 1) | F.coalesce(F.get("same", i - 1), F.lit(False)) | F.coalesce(F.get("same", i + 1), F.lit(False))))
    cells = F.transform(sure, lambda i: F.struct(i.alias("i"), F.when(F.get("form", i).startswith("#"), F.get("given", i)).alias("given"), F.get("tokens", i + F.col("shift")).alias("found")))
    lined = common.once(lined, "cells", cells)
    # An occurrence is one alignment (2), or all that begin within an item's length (0, and 1 half a length on): words put in or left out move the rest.
    step = F.col("shift") / F.col("n")
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.floor(step).alias("at")), F.struct(F.lit(1).alias("kind"), F.floor(step + 0.5).alias("at")), F.struct(F.lit(2).alias("kind"), F.col("shift").cast("long").alias("at")))
    lined = lined.select("doc_id", "item_id", "shift", "held", "ranks", "n", "n_windows", "n_places", "cells", F.size("cells").alias("m"), F.explode(kinds).alias("where"))
    lined = common.cut(spark, lined, "benchmark-lined")
    key = ["doc_id", "item_id", "where"]
    # Of several alignments in an occurrence, that with the most equal words fills a place.
    filled = lined.select(*key, "m", "shift", F.explode("cells").alias("c")).groupBy(*key, "c.i").agg(F.max_by("c", F.struct("m", "shift")).alias("c"))
    filled = common.cut(spark, filled.select(*key, "c.given", "c.found"), "benchmark-filled")
    counted = filled.where("given is not null").groupBy(*key, "given", "found").agg(F.count("*").alias("n"))
    best = counted.groupBy(*key, "given").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    agree = best.groupBy(*key).agg((F.sum("best") / F.sum("n")).alias("agreement"))
    held = filled.groupBy(*key).agg(F.count("*").alias("words"))
    need = F.least(F.lit(RUN - WINDOW + 1), F.col("n_places"))
    run = F.exists(F.sequence(F.lit(0), F.size("ranks") - 1), lambda k: F.coalesce(F.get("ranks", (k + need - 1).cast("int")) - F.get("ranks", k) == need - 1, F.lit(False)))
    judged = lined.join(agree, key, "left").join(held, key).withColumn("agreement", F.coalesce("agreement", F.lit(1.0))).where(F.col("agreement") >= AGREEMENT)
    found = judged.groupBy("doc_id", "item_id").agg((F.size(F.array_distinct(F.flatten(F.collect_set("held")))) / F.first("n_windows")).alias("coverage"), F.max("agreement").alias("agreement"), F.max(F.when(F.col("where.kind") == 2, run).otherwise(F.lit(False)) | (F.col("words") >= WORDS * F.col("n"))).alias("whole"))
    return found.where((F.col("coverage") >= COVERAGE) | F.col("whole")).select("doc_id", "item_id", "coverage", "agreement")


def flag(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_ids (sorted), coverage (the best; 0.0 if none).

    An empty benchmark leaves all documents clean; a null doc_id is never contaminated.
    """
    found = contamination(spark, docs, benchmark).groupBy(F.col("doc_id").alias("k")).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("best"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = own.join(found, own.doc_id == found.k, "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("best", F.lit(0.0)).alias("coverage")).withColumn("n_items", F.when(F.col("contaminated"), F.col("n_items")).otherwise(F.lit(0).cast("long")))
