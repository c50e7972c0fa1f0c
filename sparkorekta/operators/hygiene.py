"""Hygiene of data sets: names and entities in texts, templates, near templates, keyed overlap, set comparisons."""

from __future__ import annotations

import difflib
import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .score import normalized, template_tokens, token_distance

#: Letters whose marks are dropped: those of Polish, and other Latin ones with a mark of their own code.
_MARKED, _PLAIN = "ąćęłńóśźżàáâãäåçèéêëìíîïñòôõöùúûüýÿšž", "acelnoszzaaaaaaceeeeiiiinooooouuuuyysz"
#: Endings of cases, longest first, and what is left of a name at least.
ENDINGS, LEAST = "iami iego ami ach iem owi iej emu ej om em im ym ie a e y i u".split(), 3


def plain(text: Column) -> Column:
    """Lower case without marks on letters."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}", ""), _MARKED, _PLAIN)


def slug(text: Column) -> Column:
    """plain() with runs of all else than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(plain(text), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")


def name_stem(word: Column) -> Column:
    """A name without the ending of its case: a nasal vowel, or the first ending that leaves LEAST letters; -ek becomes -k."""
    nasal = F.lower(word).rlike("[ąę]\\z")
    bare = plain(F.when(nasal, F.regexp_replace(F.lower(word), "[ąę]\\z", "")).otherwise(word))
    cut = bare
    for ending in reversed(ENDINGS):
        # The last test made is the first that counts.
        cut = F.when(bare.endswith(ending) & (F.length(bare) - len(ending) >= LEAST), F.left(bare, F.length(bare) - len(ending))).otherwise(cut)
    stem = F.when(nasal, bare).otherwise(cut)
    return F.when(stem.endswith("ek") & (F.length(stem) > 4), F.concat(F.left(stem, F.length(stem) - 2), F.lit("k"))).otherwise(stem)


def name_key(surface: Column) -> Column:
    """The stems of a name's words, joined."""
    return F.array_join(F.transform(F.regexp_extract_all(surface, F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0)), name_stem), "_")


SPANS = "array<struct<start:int,end:int,surface:string>>"


def entities(known: list[str] | None = None):
    """An Arrow function of text: {start, end, surface} of known names and of groups of words that look like names.

    Known names come first, the longest before shorter ones; a group is words with a capital (or all capitals)
    with only space between; a single one does not count at the beginning of a sentence. Which name is the
    longest over a whole text can't be told by one pattern, so this is no builtin.
    """
    import re

    names = [(re.compile(re.escape(n), re.I), n) for n in sorted(set(known or []), key=lambda n: (-len(n), n))]
    word = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")

    def of(text: str) -> list[dict]:
        taken: list[tuple[int, int]] = []
        free = lambda a, b: all(b <= x or y <= a for x, y in taken)
        for pattern, _ in names:
            for m in pattern.finditer(text):
                a, b = m.span()
                if not (a and text[a - 1].isalpha()) and not text[b : b + 1].isalpha() and free(a, b):
                    taken.append((a, b))
        runs: list[list[int]] = []
        open_ = False
        for m in word.finditer(text):
            a, b = m.span()
            letters = [c for c in m.group() if c.isalpha()]
            if not free(a, b) or not letters[0].isupper():
                open_ = False
            elif open_ and not text[runs[-1][1] : a].strip():
                runs[-1][1:] = [b, runs[-1][2] + 1]
            else:
                runs.append([a, b, 1])
                open_ = True
        before = lambda a: text[:a].rstrip()[-1:]
        taken += [(a, b) for a, b, n in runs if n > 1 or before(a) not in ("", ".", "!", "?")]
        return [{"start": a, "end": b, "surface": text[a:b]} for a, b in sorted(taken)]

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([of(t) if t is not None else None for t in texts])

    return find


def signature(spans: Column) -> Column:
    """The stems of all names of a text, sorted: equal for texts about the same names in other cases."""
    return F.array_sort(F.flatten(F.transform(spans, lambda s: F.split(name_key(s.surface), "_"))))


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """The composed form (NFC); no builtin function makes it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def entity_template(text: Column, spans: Column) -> Column:
    """Lower case with single spaces; names, URLs and numbers are placeholders."""
    until = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1).end)
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, until(i) + 1, s.start - until(i)), F.lit("<entity>")))
    whole = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(spans, -1).end + 1, F.lit(1 << 30)))).otherwise(text)
    return F.regexp_replace(F.regexp_replace(normalized(whole), r"https?://\S+", "<url>"), r"(?<![\p{L}\p{N}_])\p{Nd}+(?:[.,]\p{Nd}+)?(?![\p{L}\p{N}_])", "<number>")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the tokens in matching blocks over all tokens of two arrays (longest blocks first); no builtin computes it."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, list(x), list(y), autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def near_templates(cases: DataFrame, least: float = 0.92, short: int = 8) -> DataFrame:
    """a, b, ratio, distance: pairs of cases (id, template) whose templates are near: a ratio of `least`, or one edit in up to `short` tokens.

    Pairs can only be near if they share a rare token or nearly all tokens: they are joined on the tokens of a
    prefix in order of rarity, long enough for either condition (and all short templates on their lengths), then
    compared. Equal templates are compared once and given for every pair of their cases.
    """
    each = cases.select("id", template_tokens(F.col("template")).alias("t")).where("id is not null and t is not null")
    kinds = each.groupBy("t").agg(F.collect_list("id").alias("ids")).withColumn("k", F.xxhash64("t")).withColumn("n", F.size("t"))
    tokens = kinds.select("k", "n", F.posexplode("t").alias("p", "w")).groupBy("k", "n", "w").agg(F.count("*").alias("c"))
    seen = tokens.groupBy("w").agg(F.count("*").alias("df"))
    ranked = tokens.join(seen, "w").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w", "c"))).alias("ws"))
    # A ratio r of lengths n and m leaves out at most (2 / r - 1) n - n + ... < n (1 - r / (2 - r)) tokens of a template, one edit one.
    miss = F.greatest(F.ceil(F.col("n") * (1 - least / (2 - least)) + 1e-9), F.when(F.col("n") <= short, F.lit(1)).otherwise(0))
    first = F.filter("ws", lambda x, i: F.aggregate(F.slice("ws", 1, i), F.lit(0).cast("long"), lambda a, y: a + y.c) <= miss)
    keys = ranked.select("k", "n", F.explode(first).alias("x")).select("k", "n", F.col("x.w").alias("w"))
    # Templates of one token or none can differ in all they have.
    tiny = kinds.where("n <= 2").select("k", "n", F.lit("\x00").alias("w"))
    keys = keys.unionByName(tiny)
    a, b = keys.alias("a"), keys.alias("b")
    close = F.greatest("a.n", "b.n") * least <= (F.col("a.n") + F.col("b.n")) / 2 + 1e-9
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.k") < F.col("b.k")) & (close | ((F.greatest("a.n", "b.n") <= short) & (F.abs(F.col("a.n") - F.col("b.n")) <= 1)))).select(F.col("a.k").alias("ka"), F.col("b.k").alias("kb")).distinct()
    left, right = kinds.select(F.col("k").alias("ka"), F.col("t").alias("ta"), F.col("ids").alias("ia")), kinds.select(F.col("k").alias("kb"), F.col("t").alias("tb"), F.col("ids").alias("ib"))
    rated = pairs.join(left, "ka").join(right, "kb").withColumn("ratio", ratio("ta", "tb")).withColumn("distance", token_distance(F.col("ta"), F.col("tb")))
    rated = rated.where((F.col("ratio") >= least) | ((F.greatest(F.size("ta"), F.size("tb")) <= short) & (F.col("distance") <= 1)))
    apart = rated.select(F.explode("ia").alias("x"), "ib", "ratio", "distance").select("x", F.explode("ib").alias("y"), "ratio", "distance")
    same = kinds.where(F.size("ids") > 1).select(F.explode("ids").alias("x"), "ids").select("x", F.explode("ids").alias("y"), F.lit(1.0).alias("ratio"), F.lit(0).alias("distance")).where("x < y")
    return apart.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ratio", "distance")


def keyed_grams(key: bytes):
    """An Arrow function of text: HMAC-SHA-256 of its distinct character 5-grams (shorter texts: of all), so sets can be compared without the texts."""
    if len(key) != 32:
        raise ValueError("the key has to have 32 bytes")

    @F.pandas_udf("array<binary>")
    def grams(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            parts = None if t is None else sorted({t[k : k + 5] for k in range(max(1, len(t) - 4))})
            out.append(None if parts is None else [hmac.new(key, p.encode(), hashlib.sha256).digest() for p in parts])
        return pd.Series(out)

    return grams


def keyed_overlap(left: DataFrame, right: DataFrame, key: bytes, threshold: float = 0.85) -> DataFrame:
    """exact and near: how many pairs of distinct texts of two sets are equal, and how many others have a Jaccard similarity >= threshold of keyed grams.

    Texts are joined on their keyed grams that are rare enough to matter (the prefix in order of rarity).
    """
    marks = keyed_grams(key)
    side = lambda df, name: df.select(normalized(F.col("text")).alias("t")).where("t is not null").distinct().select(F.lit(name).alias("side"), F.xxhash64("t").alias("id"), F.array_distinct(marks("t")).alias("g"))
    both = side(left, "l").unionByName(side(right, "r"))
    each = both.select("side", "id", F.size("g").alias("n"), F.explode("g").alias("w"))
    ranked = each.join(each.groupBy("w").agg(F.count("*").alias("df")), "w").groupBy("side", "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    keys = ranked.select("side", "id", "n", F.explode(F.slice("ws", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("x")).select("side", "id", "n", F.col("x.w").alias("w"))
    a, b = keys.where("side = 'l'").alias("a"), keys.where("side = 'r'").alias("b")
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n"))).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    sets = pairs.join(both.where("side = 'l'").select(F.col("id").alias("x"), F.col("g").alias("gx")), "x").join(both.where("side = 'r'").select(F.col("id").alias("y"), F.col("g").alias("gy")), "y")
    rated = sets.select((F.col("x") == F.col("y")).alias("same"), (F.size(F.array_intersect("gx", "gy")) / F.size(F.array_union("gx", "gy"))).alias("j"))
    return rated.agg(F.count_if("same").alias("exact"), F.count_if(~F.col("same") & (F.col("j") >= threshold)).alias("near"))


def missing_and_unknown(have: DataFrame, want: DataFrame, column: str) -> DataFrame:
    """column and side (missing, unknown): values of one set that the other lacks."""
    anti = lambda a, b, name: a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti").select(column, F.lit(name).alias("side"))
    return anti(want, have, "missing").unionByName(anti(have, want, "unknown"))


def one_sided_pairs(cases: DataFrame) -> DataFrame:
    """id, counterpart_id of cases whose counterpart is missing, is the case itself or does not name it back."""
    back = cases.select(F.col("id").alias("other"), F.col("counterpart_id").alias("names"))
    own = cases.where("counterpart_id is not null").join(back, F.col("counterpart_id") == F.col("other"), "left")
    return own.where(~F.coalesce((F.col("names") == F.col("id")) & (F.col("id") != F.col("counterpart_id")), F.lit(False))).select("id", "counterpart_id")


def repeated(cases: DataFrame, *columns: str) -> DataFrame:
    """The columns and n: values that occur more than once."""
    return cases.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def balance(cases: DataFrame, by: list[str], least: int) -> DataFrame:
    """by, n, enough: cases of each group and whether there are at least so many."""
    return cases.groupBy(*by).agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= least)


def is_date(text: Column) -> Column:
    """Whether a text is a day of the calendar, written year-month-day."""
    return F.coalesce(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def best(items: Column, limit: int) -> Column:
    """The first `limit` distinct items, in order."""
    return F.slice(F.array_distinct(items), 1, limit)
