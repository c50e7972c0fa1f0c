"""Readers and sinks: texts, canonical result JSON, frequency lists, data sets and corpora in JSON and XML."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect

#: Input below which a table may have fewer row groups than there are cores.
SMALL = 32 << 20


def spread(df: DataFrame, small: int = SMALL) -> DataFrame:
    """df dealt over all cores if it has under `small` bytes a core: a file of one row group is read by one task, however it is cut."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * small else df


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), text: each UTF-8 file whole."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


#: Version and fields of a result's wire form.
SCHEMA_VERSION = 1
FIELDS = {"result": {"schema_version", "text", "options", "issues"}, "options": {"categories", "minimum_confidence"}, "issue": {"id", "category", "severity", "message", "explanation", "original", "suggestion", "start", "end", "confidence", "source"}}
CATEGORIES = ("inflection", "agreement", "syntax", "spelling", "punctuation", "style")
SEVERITIES = ("error", "warning", "suggestion")
_ISSUE = "struct<category:string,confidence:double,end:int,explanation:string,id:string,message:string,original:string,severity:string,source:string,start:int,suggestion:string>"
RESULT = f"struct<issues:array<{_ISSUE}>,options:struct<categories:array<string>,minimum_confidence:double>,schema_version:int,text:string>"


def to_result_json(analyzed: DataFrame, categories: list[str] | None = None, minimum_confidence: float = 0.0) -> DataFrame:
    """doc_id, json: canonical results (sorted keys, no spaces, nulls kept, non-ASCII as it is) of analyze(); the options are those it was called with."""
    own = detect.with_issue_ids(analyzed)
    issue = lambda f, i: F.struct(*[c.alias(n) for n, c in sorted({**{n: f[n] for n in ("category", "confidence", "end", "explanation", "message", "original", "severity", "start", "suggestion")}, "id": F.get("__ids", i), "source": F.concat(F.lit("rule:"), f.source)}.items())])
    names = F.lit(None).cast("array<string>") if categories is None else F.array(*map(F.lit, sorted(categories))).cast("array<string>")
    options = F.struct(names.alias("categories"), F.lit(float(minimum_confidence)).alias("minimum_confidence"))
    body = F.struct(F.transform("issues", issue).alias("issues"), options.alias("options"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.coalesce("text", F.lit("")).alias("text"))
    return own.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def _once_each(pairs: list) -> dict:
    keys = [k for k, _ in pairs]
    if len(keys) != len(set(keys)):
        raise ValueError("a key occurs twice")
    return dict(pairs)


def _no_constant(value: str):
    raise ValueError(f"{value} is no number")


def _need(test: bool, what: str) -> None:
    if not test:
        raise ValueError(what)


def check_result(raw: str) -> dict:
    """The parsed wire form of a result; ValueError tells what is wrong with it."""
    _need(isinstance(raw, str), "no text")
    body = json.loads(raw, object_pairs_hook=_once_each, parse_constant=_no_constant)
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    share = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) and 0 <= x <= 1
    _need(isinstance(body, dict) and set(body) == FIELDS["result"], "fields of the result")
    _need(whole(body["schema_version"]) and body["schema_version"] == SCHEMA_VERSION, "schema version")
    _need(isinstance(body["text"], str) and isinstance(body["issues"], list), "text or issues")
    options = body["options"]
    _need(isinstance(options, dict) and set(options) == FIELDS["options"] and share(options["minimum_confidence"]), "options")
    named = options["categories"]
    _need(named is None or (isinstance(named, list) and all(c in CATEGORIES for c in named) and len(named) == len(set(named))), "categories")
    seen = set()
    for f in body["issues"]:
        _need(isinstance(f, dict) and set(f) == FIELDS["issue"], "fields of an issue")
        _need(all(isinstance(f[k], str) for k in ("id", "category", "severity", "message", "explanation", "original", "source")) and isinstance(f["suggestion"], str | None), "type of a field")
        _need(f["category"] in CATEGORIES and f["severity"] in SEVERITIES, "category or severity")
        _need(bool(f["message"].strip() and f["explanation"].strip()), "message or explanation is blank")
        _need(re.fullmatch(r"(rule|llm):[a-z0-9][a-z0-9._-]*", f["source"]) is not None, "source")
        _need(whole(f["start"]) and whole(f["end"]) and 0 <= f["start"] <= f["end"] and share(f["confidence"]), "span or confidence")
        _need(body["text"][f["start"] : f["end"]] == f["original"] and len(f["original"]) == f["end"] - f["start"], "original and text differ")
        _need(f["suggestion"] != f["original"], "suggestion equals original")
        kind, name = f["source"].split(":", 1)
        _need(kind != "rule" or f["id"] == detect.finding_id(f["category"], f["start"], f["end"], f["original"], f["suggestion"], name), "id")
        _need(f["id"] not in seen, "an id occurs twice")
        seen.add(f["id"])
    return body


def from_result_json(rows: DataFrame) -> DataFrame:
    """rows with valid, error (what is wrong, else null) and r (the parsed result, null if not valid).

    Strict: the exact fields at each level, no key twice, finite numbers, known categories, and spans and ids
    that fit. Repeated keys can't be seen by builtin functions, so the check is an Arrow function.
    """

    @F.pandas_udf("string")
    def faults(raw: pd.Series) -> pd.Series:
        out = []
        for x in raw:
            try:
                check_result(x)
                out.append(None)
            except (ValueError, TypeError) as e:
                out.append(str(e) or type(e).__name__)
        return pd.Series(out, dtype="object")

    out = rows.withColumn("error", faults("json")).withColumn("valid", F.col("error").isNull())
    return out.withColumn("r", F.when(F.col("valid"), F.from_json("json", RESULT)))


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """word, n of a frequency CSV (word, count, deleted): kept words of two letters or more, lower-cased, counts of at least 1. Another header is an error."""
    rows = spark.read.csv(path, header=True, enforceSchema=False)
    if rows.columns != ["word", "count", "deleted"]:
        raise ValueError(f"{path}: the header has to be word, count, deleted")
    word = F.lower(F.trim("word"))
    return rows.where((F.coalesce("deleted", F.lit("")) != "1") & word.rlike(r"\A\p{L}{2,}\z")).select(word.alias("word"), F.greatest(F.coalesce(F.try_to_number("count", F.lit("999999999999999999")).cast("long"), F.lit(1)), F.lit(1)).alias("n"))


def write_frequency_list(words: DataFrame, path: str) -> None:
    """Writes word and n as lines of two fields."""
    words.select("word", "n").write.csv(path, sep=" ", header=False, mode="errorifexists")


FINDING = "array<struct<category:string,start:int,end:int,original:string,suggestion:string,rationale:string>>"
#: Cases of an evaluation data set, and of a quality data set of any version (fields of later versions are null in earlier ones).
EVALUATION_CASE = f"struct<id:string,outcome:string,text:string,expected_findings:{FINDING}>"
QUALITY_CASE = f"struct<id:string,kind:string,category:string,phenomenon:string,pair_id:string,features:array<string>,shape_strata:array<string>,text:string,expected_findings:{FINDING},rationale:string>"
CORPUS_CASE = "struct<id:string,stratum:string,split:string,unit:string,input:string,expected_output:string,description:string,tags:array<string>,normalized_template:string,entity_ids:array<string>,entity_spans:array<struct<start:int,end:int,surface:string>>,edits:array<struct<category:string,start:int,end:int,original:string,suggestion:string,rationale:string>>>"


def read_cases(spark: SparkSession, path: str, case: str = CORPUS_CASE) -> DataFrame:
    """The cases of a JSON data set, a row each, with dataset (its id) and schema_version; the schema is given, not guessed."""
    schema = f"schema_version int, id string, cases array<{case}>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.col("id").alias("dataset"), "schema_version", F.explode("cases").alias("c")).select("dataset", "schema_version", "c.*")


def invalid_cases(cases: DataFrame, text: str = "text", findings: str = "expected_findings") -> DataFrame:
    """id and fault of cases that break a rule: an id that repeats or is missing, a span that does not fit its text, a suggestion that equals the original, conflicting findings."""
    f = F.col(findings)
    fits = F.forall(f, lambda x: (x.start >= 0) & (x.start <= x.end) & (F.substring(text, x.start + 1, x.end - x.start) == x.original))
    same = F.exists(f, lambda x: x.suggestion == x.original)
    clash = F.exists(f, lambda a: F.size(F.filter(f, lambda b: detect.conflict(a, b))) > 1)
    fault = F.when(F.col("id").isNull() | (F.trim("id") == ""), "id is missing").when(F.col(text).isNull(), "text is missing").when(~F.coalesce(fits, F.lit(True)), "span and text differ").when(F.coalesce(same, F.lit(False)), "suggestion equals original").when(F.coalesce(clash, F.lit(False)), "findings conflict")
    single = cases.select("id", fault.alias("fault")).where("fault is not null")
    twice = cases.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id occurs twice").alias("fault"))
    return single.unionByName(twice)


def read_cases_xml(spark: SparkSession, path: str) -> DataFrame:
    """The cases of an XML corpus, a row each; attributes are columns, finding an array."""
    finding = "array<struct<category:string,start:int,end:int,original:string,suggestion:string>>"
    schema = f"id string, verification string, tags string, input string, expected_output string, expected_findings struct<finding:{finding}>"
    return spark.read.schema(schema).format("xml").option("rowTag", "case").option("attributePrefix", "").load(path).withColumn("expected_findings", F.col("expected_findings.finding"))


def write_report(report: DataFrame, path: str) -> str:
    """Writes a report as JSON lines and returns the SHA-256 of its rows, which does not depend on their order."""
    report.write.json(path, mode="errorifexists")
    rows = report.select(F.sha2(F.to_json(F.struct(*sorted(report.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)).first()[0]
