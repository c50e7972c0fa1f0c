"""The command line: analyze one text and show, or apply, what is found.

Exit codes: 0 done, 1 the selected findings can't be applied, 2 wrong input or configuration.
"""

from __future__ import annotations

import argparse
import json
import sys
from io import TextIOWrapper

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Options, from_toml
from .errors import KorektaError
from .operators import detect
from .sources import io


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sparkorekta")
    own = parser.add_subparsers(dest="command", required=True).add_parser("analyze")
    own.add_argument("text", nargs="?")
    own.add_argument("--config")
    own.add_argument("--file")
    own.add_argument("--stdin", action="store_true")
    own.add_argument("--json", action="store_true")
    own.add_argument("--category", action="append")
    own.add_argument("--minimum-confidence", type=float)
    own.add_argument("--apply", action="append", metavar="ID")
    return parser.parse_args(argv)


def _input(a: argparse.Namespace) -> str:
    """Standard input before a file before the argument."""
    if a.stdin:
        return sys.stdin.read()
    if a.file is not None:
        with open(a.file, encoding="utf-8", newline="") as f:
            return f.read()
    if a.text is None:
        raise ValueError("a text, --file or --stdin is needed")
    return a.text


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments(argv)
    try:
        base = from_toml(a.config) if a.config else Options()
        options = Options(base.categories if a.category is None else tuple(a.category), base.minimum_confidence if a.minimum_confidence is None else a.minimum_confidence)
        text = _input(a)
    except (KorektaError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    found = detect.analyze(docs, **options.arguments())
    corrected = None
    if a.apply:
        done = detect.apply_selected(found.withColumn("chosen", F.array(*map(F.lit, a.apply)))).first()
        if done["error_code"]:
            print(f"error: {done['error_code']}", file=sys.stderr)
            return 1
        corrected = done["corrected"]
    if a.json:
        result = io.to_result_json(found, options.arguments()["categories"], options.minimum_confidence).first()["json"]
        if corrected is not None:
            result = json.dumps({"analysis_result": json.loads(result), "corrected_text": corrected}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        print(result)
    elif corrected is not None:
        print(corrected)
    else:
        row = detect.with_issue_ids(found).first()
        lines = ["\t".join([i, f["category"], f["severity"], f["message"], f"rule:{f['source']}", str(f["confidence"])]) for i, f in zip(row["__ids"], row["issues"])]
        print("\n".join(lines) or "No findings.")
    return 0


def main(argv: list[str] | None = None) -> None:
    for stream in (sys.stdin, sys.stdout, sys.stderr):
        if isinstance(stream, TextIOWrapper):
            stream.reconfigure(encoding="utf-8")
    raise SystemExit(run(argv))


if __name__ == "__main__":
    main()
