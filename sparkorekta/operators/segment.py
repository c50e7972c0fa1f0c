"""Paragraphs and sentences with offsets; the pieces of a text concatenate to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, scan

#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = "al doc dr itd itp m.in miedzy nr np prof r s tj tzn ul".split()
_MASK = "\ue001"
#: Fixed value: marks that close a quotation or bracket after a sentence's end.
_CLOSING = "['\"”’»)\\]}]"


def _with_offsets(pieces: Column) -> Column:
    """Array of {start, end, text} of consecutive pieces."""
    kind = "struct<start:int,end:int,text:string>"
    return scan(pieces, F.lit(0), kind, lambda at, x: (at + F.length(x), F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("text"))))


def paragraphs_of(text: Column) -> Column:
    """A paragraph ends after a blank line; empty text has none."""
    return let(F.regexp_extract_all(text, F.lit(r"(?s).+?(?:\r?\n[ \t]*\r?\n+|\z)"), F.lit(0)), _with_offsets)


def sentences_of(text: Column) -> Column:
    """A sentence ends at . ! ? (with closing marks) before white space or the end, but not at an abbreviation's or a decimal's dot, and after a blank line.

    The first dot after an abbreviation that stands alone (dots aside) is masked by a character of equal length,
    and no end begins in the dots after it; the pieces' texts are taken from the original.
    """
    dots = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    known = rf"(?iu)(?<![\p{{L}}\p{{N}}.])({dots})\.(?=\.*(?![\p{{L}}\p{{N}}.]))"
    ends = rf"(?s).+?(?:(?<!{_MASK}\.{{0,40}})[.!?]+{_CLOSING}*(?=\s|\z)(?:\s*?(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)+)?|\r?\n[ \t]*\r?\n+|\z)"

    def cut(masked: Column) -> Column:
        pieces = let(F.regexp_extract_all(masked, F.lit(ends), F.lit(0)), _with_offsets)
        own = lambda p: F.struct(p.start.alias("start"), p.end.alias("end"), F.substring(text, p.start + 1, p.end - p.start).alias("text"))
        return F.when(masked == text, pieces).otherwise(F.transform(pieces, own))

    return let(F.when(text.rlike(known), F.regexp_replace(text, known, f"$1{_MASK}")).otherwise(text), cut)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, pos, start, end, text. Null and empty texts have none."""
    return docs.select("doc_id", F.posexplode(paragraphs_of(F.col("text").cast("string"))).alias("pos", "p")).select("doc_id", "pos", "p.*")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, start, end, text. Null and empty texts have none."""
    return docs.select("doc_id", F.posexplode(sentences_of(F.col("text").cast("string"))).alias("pos", "p")).select("doc_id", "pos", "p.*")
