"""Detection, normalisation, selection and application of findings, all within a row: no shuffle."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ANY_QUOTE, HAS_QUOTES, SPAN, Place, let, lookup, scan, spans
from .catalog import LITERALS, POLICY_VERSION, SOURCES, Rule, entries, policy, rules
from .segment import sentences_of

FINDING = "struct<start:int,end:int,original:string,suggestion:string,category:string,severity:string,message:string,explanation:string,confidence:double,source:string,rule_ord:int>"
#: What a finding of a category says.
MESSAGES = {"agreement": "Niezgodność form wyrazów.", "inflection": "Niewłaściwa forma odmiany.", "spelling": "Pisownia wymaga poprawki.", "syntax": "Budowa zdania wymaga poprawki.", "punctuation": "Interpunkcja wymaga poprawki.", "style": "Styl wymaga poprawki."}
#: Names of columns that hold a row's text and its lower case while it is analysed.
_TEXT, _LOW = "__text", "__low"


def finding(start: Column, end: Column, original: Column, suggestion: Column, category: str, severity: str, confidence: Column, source: Column | str) -> Column:
    """A finding's struct; message and explanation follow from category, original and suggestion."""
    say = F.when(original == "", F.concat(F.lit("Należy wstawić „"), suggestion, F.lit("”."))).when(suggestion == "", F.concat(F.lit("Należy usunąć „"), original, F.lit("”."))).otherwise(F.concat(F.lit("Zamiast „"), original, F.lit("” należy napisać „"), suggestion, F.lit("”.")))
    order = F.lit(SOURCES.index(source)) if isinstance(source, str) else lookup({s: k for k, s in enumerate(SOURCES)}, source)
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(start.alias("start"), end.alias("end"), original.alias("original"), suggestion.alias("suggestion"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(MESSAGES[category]).alias("message"), say.alias("explanation"), confidence.cast("double").alias("confidence"), source.alias("source"), order.alias("rule_ord"))


def _accepted(hits: Column, text: Column, between: str | None, stop: bool) -> Column:
    """Hits of a closed template: in each sentence those from the first one that begins it or follows a colon on.

    A sentence is left out as a whole if something else stands between two of them, or if it has to end in a
    full stop and does not.
    """
    begin = lambda x: x.end - F.length(x.hit)

    def of(s: Column) -> Column:
        inside = F.filter(hits, lambda x: (begin(x) >= s.start) & (x.end <= s.end))
        first = F.filter(inside, lambda x: F.substring(text, s.start + 1, begin(x) - s.start).rlike(r"(?:\A|:)[\s\x1c-\x1f\x85\p{Z}]*\z"))

        def judged(kept: Column) -> Column:
            good = F.size(kept) > 0
            if between is not None:
                gaps = F.transform(kept, lambda x, i: (i == 0) | F.substring(text, F.get(kept, i - 1).end + 1, begin(x) - F.get(kept, i - 1).end).rlike(rf"\A{between}\z"))
                good = good & F.forall(gaps, lambda g: g)
            if stop:
                last = F.element_at(kept, -1).end
                good = good & F.substring(text, last + 1, s.end - last).rlike(r"\A[\s\x1c-\x1f\x85\p{Z}]*\.+\z")
            return F.when(good, kept).otherwise(F.array().cast(f"array<{SPAN}>"))

        return let(F.filter(inside, lambda x: x.start >= F.get(first, 0).start), judged)

    return F.when(F.size(hits) > 0, F.flatten(F.transform(sentences_of(text), of))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _found(rule: Rule, text: Column, low: Column) -> Column:
    none = F.array().cast(f"array<{SPAN}>")

    def made(x: Column) -> Column:
        source = rule.source_of(x.original) if rule.source_of else rule.source
        sure = lookup({t: c for t, _, _, c in LITERALS}, F.lower(x.original)) if rule.source_of else F.lit(rule.confidence)
        return finding(x.start, x.end, x.original, rule.suggest(x.original, x.hit), rule.category, rule.severity, sure, source)

    hits = spans(_TEXT, rule.pattern, rule.group)
    if rule.gate:
        hits = F.when(reduce(or_, (F.contains(low, F.lit(g)) for g in rule.gate)), hits).otherwise(none)
    if rule.template:
        hits = let(hits, lambda h: _accepted(h, text, *rule.template))
    if rule.abstain:
        hits = F.filter(hits, lambda x: ~F.coalesce(rule.abstain(Place(text, x.start, x.end, x.hit)), F.lit(True)))
    if rule.single_sentence:
        hits = F.when(text.rlike(rule.pattern) & (F.size(sentences_of(text)) == 1), hits).otherwise(none)
    return F.filter(F.transform(hits, made), lambda f: f.suggestion.isNotNull() & (f.suggestion != f.original))


@lru_cache(maxsize=None)
def _built(compat: bool, order: int) -> Column:
    """The expression of a detector over a row's text and its lower case; building one takes many calls into the JVM."""
    return _found(rules(compat)[order], F.col(_TEXT), F.col(_LOW))


def canonical(found: Column) -> Column:
    """Findings by start, end, falling confidence, category, source and suggestion."""
    keyed = F.transform(found, lambda f: F.struct(F.struct(f.start, f.end, -f.confidence, f.category, f.source, f.suggestion).alias("k"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda x: x.f)


def analyze(docs: DataFrame, categories: Iterable[str] | None = None, minimum_confidence: float = 0.0, sources: Iterable[str] | None = None, compat: bool = False) -> DataFrame:
    """docs with a column issues: its findings, distinct and in canonical order.

    Rules outside the categories or sources are left out of the plan (no categories: no findings). Null and
    empty texts have no findings. A column of docs that is named issues is replaced; others pass through.
    """
    wanted = None if categories is None else set(categories)
    asked = None if sources is None else list(sources)
    picked = [k for k, r in enumerate(rules(compat)) if (wanted is None or r.category in wanted) and (asked is None or any(r.source == s or (r.source_of and s in {f"spelling.{x[2]}" for x in LITERALS}) for s in asked))]
    # Text, its lower case and the findings are each computed once a row, whatever reads them; what no rule reads is left out.
    docs = once(docs.drop("issues"), _TEXT, F.coalesce(F.col("text").cast("string"), F.lit("")))
    docs = once(docs, _LOW, F.lower(_TEXT)) if any(rules(compat)[k].gate for k in picked) else docs
    docs = once(docs, HAS_QUOTES, F.col(_TEXT).rlike(ANY_QUOTE)) if any(rules(compat)[k].abstain for k in picked) else docs
    arrays = [_built(compat, k) for k in picked]
    found = F.array_distinct(F.concat(*arrays)) if arrays else F.array().cast(f"array<{FINDING}>")
    kept = F.filter(found, lambda f: (f.confidence >= minimum_confidence) & (f.source.isin(asked) if asked is not None else F.lit(True)))
    return once(docs, "issues", canonical(kept)).drop(_TEXT, _LOW, HAS_QUOTES)


def findings(docs: DataFrame, **options) -> DataFrame:
    """A row for each finding: doc_id and its fields."""
    return analyze(docs, **options).select("doc_id", F.explode("issues").alias("f")).select("doc_id", "f.*")


def filter_findings(found: DataFrame, categories: Iterable[str] | None = None, minimum_confidence: float = 0.0) -> DataFrame:
    out = found.where(F.col("confidence") >= minimum_confidence)
    return out if categories is None else out.where(F.col("category").isin(list(categories)))


def deduplicate_findings(found: DataFrame) -> DataFrame:
    """One row for each doc_id and id: that with the highest confidence, then the least message."""
    best = Window.partitionBy("doc_id", "id").orderBy(F.desc("confidence"), "message")
    return found.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def prioritize_findings(found: DataFrame) -> DataFrame:
    """found with rank (from 1): its place within the document in canonical order."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", F.desc("confidence"), "category", "source", "id")
    return found.withColumn("rank", F.row_number().over(order))


def normalize_findings(found: DataFrame, categories: Iterable[str] | None = None, minimum_confidence: float = 0.0) -> DataFrame:
    return prioritize_findings(deduplicate_findings(filter_findings(found, categories, minimum_confidence)))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generator of one row, into which no later operator is folded."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def conflict(a: Column, b: Column) -> Column:
    """Whether two findings can't both be applied: replacements overlap, insertions share a place, or an insertion touches a replacement (ends included)."""
    ia, ib = a.start == a.end, b.start == b.end
    return F.when(ia & ib, a.start == b.start).when(ia, (b.start <= a.start) & (a.start <= b.end)).when(ib, (a.start <= b.start) & (b.start <= a.end)).otherwise((a.start < b.end) & (b.start < a.end))


def select(issues: Column) -> Column:
    """Greedy choice in canonical order of findings that don't conflict with those chosen.

    In that order a finding can only meet the furthest end of a chosen replacement or the last chosen insertion,
    so these two numbers are all that is carried along.
    """
    kind = f"struct<f:{FINDING},take:boolean>"

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        inserts = x.start == x.end
        clash = (s.inserted == x.start) | F.when(inserts, s.until >= x.start).otherwise(s.until > x.start)
        after = F.struct(F.when(~clash & ~inserts, F.greatest(s.until, x.end)).otherwise(s.until).alias("until"), F.when(~clash & inserts, x.start).otherwise(s.inserted).alias("inserted"))
        return after, F.struct(x.alias("f"), (~clash).alias("take"))

    begin = F.struct(F.lit(-1).alias("until"), F.lit(-1).alias("inserted"))
    return F.transform(F.filter(scan(issues, begin, kind, step), lambda r: r.take), lambda r: r.f)


def apply(text: Column, chosen: Column) -> Column:
    """text with chosen findings (in order, without conflicts) put in: pieces between them are joined once."""
    until = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(chosen, i - 1).end)
    pieces = F.transform(chosen, lambda x, i: F.concat(F.substring(text, until(i) + 1, x.start - until(i)), F.coalesce(x.suggestion, F.lit(""))))
    rest = F.substring(text, F.element_at(chosen, -1).end + 1, F.lit(1 << 30))
    return F.when(F.size(chosen) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)


def eligible(f: Column, version: str = POLICY_VERSION) -> Column:
    """Whether the automatic policy holds a finding: its source with category, operation, behaviour and policy version, and the confidence."""
    known = {e[1]: e for e in entries()}
    rows = [p for p in policy() if p[4] == version and (known[p[0]][2], known[p[0]][3], known[p[0]][4]) == p[1:4]]
    least = lookup({f"{p[0]}/{p[1]}": p[5] for p in rows}, F.concat_ws("/", f.source, f.category)) if rows else F.lit(None).cast("double")
    return F.coalesce(f.confidence >= least, F.lit(False))


def join_policy(found: DataFrame, catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """found whose source the policy holds by all five columns of its key, at the confidence it asks for. catalog and policy have a row a source, so they can always be broadcast."""
    keys = ["source", "category", "operation", "behavior_version", "policy_version"]
    own = found.withColumn("policy_version", F.lit(POLICY_VERSION)).join(F.broadcast(catalog.select("source", "operation", "behavior_version")), "source", "left")
    return own.join(F.broadcast(rows.select(*keys, "minimum_confidence")), keys).where("confidence >= minimum_confidence").drop("minimum_confidence")


def correct(docs: DataFrame, sources: Iterable[str] | None = None, minimum: float = 0.9, **options) -> DataFrame:
    """docs with issues, applied, skipped and corrected: what the automatic policy holds is applied (or findings of other sources, if named).

    Columns of docs with these names are replaced. A null text is corrected to an empty one.
    """
    own = analyze(docs.drop("applied", "skipped", "corrected"), **options)
    may = (lambda f: eligible(f)) if sources is None else lambda f: f.source.isin(list(sources)) & (f.confidence >= minimum)
    own = once(own, "applied", select(F.filter("issues", may)))
    return own.withColumn("skipped", F.array_except("issues", "applied")).withColumn("corrected", let(F.coalesce(F.col("text").cast("string"), F.lit("")), lambda t: apply(t, F.col("applied"))))


#: Why a selection can't be applied.
UNKNOWN, UNCORRECTABLE, CONFLICT = "correction.unknown_finding", "correction.uncorrectable_finding", "correction.conflict"


def apply_selected(analyzed: DataFrame, chosen: str = "chosen") -> DataFrame:
    """analyzed (text, issues, a column of ids) with error_code (null: applied) and corrected (null with an error).

    All or nothing: ids have to be distinct, known and not empty, each finding needs a suggestion and has to
    stand in the text, and no two may conflict. An empty selection leaves the text; a null one is unknown.
    """
    own = with_issue_ids(analyzed.drop("error_code", "corrected", "__ids", "__picked"))
    ids = F.col(chosen)
    own = own.withColumn("__picked", F.filter(F.arrays_zip(F.col("__ids").alias("id"), F.col("issues").alias("f")), lambda x: F.array_contains(ids, x.id)))
    picked = F.transform("__picked", lambda x: x.f)
    known = ids.isNotNull() & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda i: F.coalesce(F.array_contains("__ids", i), F.lit(False)))
    fits = F.forall(picked, lambda f: f.suggestion.isNotNull() & (F.substring("text", f.start + 1, f.end - f.start) == f.original))
    code = F.when(~F.coalesce(known, F.lit(False)), UNKNOWN).when(~fits, UNCORRECTABLE).when(F.size(select(picked)) < F.size(picked), CONFLICT)
    own = once(own, "error_code", code)
    return own.withColumn("corrected", F.when(F.col("error_code").isNull(), apply(F.col("text"), picked))).drop("__ids", "__picked")


def with_issue_ids(analyzed: DataFrame) -> DataFrame:
    """analyzed with __ids: the ids of its issues, in order."""

    @F.pandas_udf("array<string>")
    def ids(issues: pd.Series) -> pd.Series:
        return pd.Series([[finding_id(f["category"], f["start"], f["end"], f["original"], f["suggestion"], f["source"]) for f in row] if row is not None else None for row in issues])

    return analyzed.withColumn("__ids", ids("issues"))


def finding_id(category: str, start: int, end: int, original: str, suggestion: str | None, source: str) -> str:
    """The stable id of a finding: BLAKE2b-128 of its canonical JSON."""
    body = {"category": category, "end": int(end), "id_version": 1, "original": original, "source": f"rule:{source}", "start": int(start), "suggestion": suggestion}
    return "finding_" + hashlib.blake2b(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode(), digest_size=16).hexdigest()


def finding_ids(category: pd.Series, start: pd.Series, end: pd.Series, original: pd.Series, suggestion: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series(list(map(finding_id, category, start, end, original, suggestion, source)), dtype="object")


def with_ids(found: DataFrame) -> DataFrame:
    """found with a column id; BLAKE2b is no builtin, so this is an Arrow function."""
    return found.withColumn("id", F.pandas_udf(finding_ids, "string")("category", "start", "end", "original", "suggestion", "source"))
