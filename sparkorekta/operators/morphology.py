"""Detectors that need a lexicon: a table of forms (form, lemma, tag, labels, version).

Candidates are found in the texts as in detect, a row each; their words are joined with the lexicon's analyses
and the chosen lemmas with its forms, so the lexicon may be of any size (Spark broadcasts it where it is
small). Whatever is not certain (no form, two lemmas, two forms) is left alone, and so is everything if the
lexicon is of another version.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ANY_QUOTE, HAS_QUOTES, NOT_AFTER_WORD, NOT_BEFORE_WORD, Place, quoted, spans, with_case, wrapped
from . import detect
from .catalog import COPULA, LEXICON_VERSION, MORPHOLOGY

LEXICON = "form string, lemma string, tag string, labels array<string>, version string"
_W = r"[\p{L}\p{Nl}\p{No}]+"
_JOIN = "i|oraz|albo|lub|ani"

#: The detectors that take a governor, then an adjective and a noun whose case it sets: governor, what follows it, its lemma and tag, the case.
GOVERNORS = {
    "inflection.government_szukac_klucz": ("szukam", "", "szukać", "fin:sg:pri:imperf", "gen"),
    "inflection.government_uzywac_telefon": ("używam", "", "używać", "fin:sg:pri:imperf", "gen"),
    "inflection.government_ufac_lekarz": ("ufam", "", "ufać", "fin:sg:pri:imperf", "dat"),
    "inflection.government_interesowac_sie_historia": ("interesuję", r"[ \t]+się", "interesować", "fin:sg:pri:imperf", "inst"),
    "inflection.government_do_sklep": ("do", "", "do:P", "prep:gen", "gen"),
}
_FIN = "fin:sg:pri:imperf"
_NEW = "adj:sg:acc:m3:pos adj:sg:nom.voc:m1.m2.m3:pos"
_THESE = "adj:pl:acc:m2.m3.f.n:pos adj:pl:nom.voc:m2.m3.f.n:pos"
#: Closed phrases. Pattern (the group is the span), what it becomes, what the lexicon has to say of words (form, lemma, tags), and the forms it has to make (lemma, tag, form).
CLOSED = {
    "agreement.nominal_group_te_duze_okno": (r"\A(Te)(?= duże okno jest otwarte\.\z)", "To", [("Te", "ten", _THESE), ("duże", "duży", _THESE + " adj:sg:acc:n:pos adj:sg:nom.voc:n:pos"), ("okno", "okno", "subst:sg:nom.acc.voc:n:ncol")], [("ten", "adj:sg:nom.voc:n:pos", "to")]),
    "agreement.nominal_group_ta_nowy_ksiazka": (rf"(?iu){NOT_AFTER_WORD}ta[ \t]+(nowy)(?=[ \t]+książka{NOT_BEFORE_WORD})", "nowa", [("Ta", "ten", "adj:sg:nom.voc:f:pos"), ("nowy", "nowy:A", _NEW), ("książka", "książka", "subst:sg:nom:f")], [("nowy:A", "adj:sg:nom.voc:f:pos", "nowa")]),
    "agreement.subject_verb_oni_czyta": (r"\AOni (czyta)(?= książkę\.\z)", "czytają", [("Oni", "on:S", "ppron3:pl:nom:m1:ter:akc.nakc:praep.npraep"), ("czyta", "czytać", "fin:sg:ter:imperf")], [("czytać", "fin:pl:ter:imperf", "czytają")]),
    "agreement.subject_verb_my_czyta": (rf"(?iu){NOT_AFTER_WORD}my (czyta)(?= (?:książkę|książke|gazetę|gazete){NOT_BEFORE_WORD})", "czytamy", [("My", "my", "ppron12:pl:nom:m1.m2.m3.f.n:pri ppron12:pl:voc:m1.m2.m3.f.n:pri"), ("czyta", "czytać", "fin:sg:ter:imperf")], [("czytać", "fin:pl:pri:imperf", "czytamy")]),
    "inflection.negated_widziec_nominal_group": (r"\ANie widzę (czerwony samochód)(?=\.\z)", "czerwonego samochodu", [("czerwony", "czerwony:A", _NEW), ("samochód", "samochód", "subst:sg:nom.acc:m3")], [("czerwony:A", "adj:sg:gen:m1.m2.m3.n:pos", "czerwonego"), ("samochód", "subst:sg:gen:m3", "samochodu")]),
    "inflection.negated_lubic_kawe": (rf"{NOT_AFTER_WORD}(?:Nie|nie|NIE) (?:lubię|Lubię|LUBIĘ) (kawę|Kawę|KAWĘ)(?=[.!?]|\z)", "kawy", [("lubię", "lubić", _FIN), ("kawę", "kawa", "subst:sg:acc:f")], [("kawa", "subst:sg:gen:f", "kawy")]),
    "inflection.przygladac_sie_nowy_budynek": (rf"(?iu){NOT_AFTER_WORD}przyglądam się (nowy budynek){NOT_BEFORE_WORD}", "nowemu budynkowi", [("przyglądam", "przyglądać", _FIN), ("nowy", "nowy:A", _NEW), ("budynek", "budynek", "subst:sg:nom.acc:m3")], [("nowy:A", "adj:sg:dat:m1.m2.m3.n:pos", "nowemu"), ("budynek", "subst:sg:dat:m3", "budynkowi")]),
    "inflection.government_potrzebowac_pomoc": (r"\APotrzebuję (pomoc)(?=\.\z)", "pomocy", [("Potrzebuję", "potrzebować", _FIN), ("pomoc", "pomoc", "subst:sg:nom:f subst:sg:acc:f")], [("pomoc", "subst:sg:gen:f", "pomocy")]),
    "inflection.government_sluchac_radio": (rf"{NOT_AFTER_WORD}(?:Słucham|słucham|SŁUCHAM) (radio|Radio|RADIO)(?=[.!?]|\z)", "radia", [("słucham", "słuchać", _FIN), ("radio", "radio", "subst:sg:nom.acc.voc:n:ncol")], [("radio", "subst:sg:gen:n:ncol", "radia")]),
    "inflection.government_byc_nauczyciel": (rf"{NOT_AFTER_WORD}(?:Jestem|jestem|JESTEM) (nauczyciel|Nauczyciel|NAUCZYCIEL)(?=[.!?]|\z)", "nauczycielem", [("jestem", "być", _FIN), ("nauczyciel", "nauczyciel", "subst:sg:nom:m1")], [("nauczyciel", "subst:sg:inst:m1", "nauczycielem")]),
}
#: Those whose closed phrase stands anywhere in a text: a word between quotes is left alone, a noun in title case too.
_GUARDED = ("inflection.negated_lubic_kawe", "inflection.government_sluchac_radio", "inflection.government_byc_nauczyciel", "inflection.przygladac_sie_nowy_budynek", "agreement.subject_verb_my_czyta", "agreement.nominal_group_ta_nowy_ksiazka")
#: Words and parts of speech that rule a reading out.
NO_ADJECTIVE = "jaki który mój nasz taki ten twój wasz żaden".split()
VERBAL = "fin ger impt imps inf pant pcon praet".split()
NOMINAL = "adj adja adjc adjp depr num numcol ppas ppron12 ppron3 winien".split()
PREPOSITIONS = "bez dla do ku nad na o od pod po przy przed przez w we z za ze".split()
#: Pronouns with number, person, lemma and the tags that they have to have.
PRONOUNS = {
    "ja": ("sg", "pri", "ja", ["ppron12:sg:nom:m1.m2.m3.f.n:pri"]),
    "ty": ("sg", "sec", "ty", ["ppron12:sg:nom:m1.m2.m3.f.n:sec", "ppron12:sg:voc:m1.m2.m3.f.n:sec"]),
    "my": ("pl", "pri", "my", ["ppron12:pl:nom:m1.m2.m3.f.n:pri", "ppron12:pl:voc:m1.m2.m3.f.n:pri"]),
    "wy": ("pl", "sec", "wy", ["ppron12:pl:nom:m1.m2.m3.f.n:sec", "ppron12:pl:voc:m1.m2.m3.f.n:sec"]),
    "on": ("sg", "ter", "on:S", ["ppron3:sg:nom:m1.m2.m3:ter:akc.nakc:praep.npraep"]),
    "ona": ("sg", "ter", "on:S", ["ppron3:sg:nom:f:ter:akc.nakc:praep.npraep"]),
    "ono": ("sg", "ter", "on:S", ["ppron3:sg:nom:n:ter:akc.nakc:praep.npraep"]),
    "oni": ("pl", "ter", "on:S", ["ppron3:pl:nom:m1:ter:akc.nakc:praep.npraep"]),
    "one": ("pl", "ter", "on:S", ["ppron3:pl:nom:m2.m3.f.n:ter:akc.nakc:praep.npraep"]),
}


def prepared(lexicon: DataFrame) -> DataFrame:
    """Rows of the version that the detectors are qualified for, with part of speech and features (number:case:gender)."""
    part = lambda k: F.split(F.get(F.split("tag", ":"), k), r"\.")
    each = F.flatten(F.transform(part(1), lambda n: F.flatten(F.transform(part(2), lambda c: F.transform(part(3), lambda g: F.concat_ws(":", n, c, g))))))
    pos = F.substring_index("tag", ":", 1)
    own = lexicon.where(F.col("version") == LEXICON_VERSION).select("form", "lemma", "tag", F.coalesce("labels", F.array().cast("array<string>")).alias("labels")).distinct()
    return own.select("form", "lemma", "tag", "labels", pos.alias("pos"), F.when(pos.isin("adj", "subst"), each).otherwise(F.array().cast("array<string>")).alias("feats"))


def _readings(words: DataFrame, column: str, rows: DataFrame, name: str) -> DataFrame:
    """words with `name`: the analyses of a column's words (all capitals are looked up in lower case), null for unknown ones."""
    word = F.when((F.col(column) == F.upper(column)) & (F.col(column) != F.lower(column)), F.lower(column)).otherwise(F.col(column))
    known = rows.groupBy(F.col("form").alias(f"__{name}")).agg(F.collect_list(F.struct("lemma", "tag", "pos", "labels", "feats")).alias(name))
    return words.withColumn("__w", word).join(known, F.col("__w") == F.col(f"__{name}"), "left").drop("__w", f"__{name}")


def _forms(words: DataFrame, lemma: str, rows: DataFrame, name: str) -> DataFrame:
    """words with `name`: the forms of a column's lemmas."""
    made = rows.groupBy(F.col("lemma").alias(f"__{name}")).agg(F.collect_list(F.struct("form", "tag", "pos", "feats")).alias(name))
    return words.join(made, F.col(lemma) == F.col(f"__{name}"), "left").drop(f"__{name}")


def _lemma(a: Column, pos: str) -> Column:
    """The one lemma of the readings of a part of speech, null if there are several or a reading is unknown."""
    own = F.array_distinct(F.transform(F.filter(a, lambda x: x.pos == pos), lambda x: x.lemma))
    return F.when((F.size(own) == 1) & ~F.exists(a, lambda x: x.tag == "ign"), F.get(own, 0))


def _feats(a: Column, pos: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.filter(a, lambda x: x.pos == pos), lambda x: x.feats)))


def _shapes(feats: Column) -> Column:
    return F.array_distinct(F.transform(feats, lambda f: F.concat_ws(":", F.substring_index(f, ":", 1), F.substring_index(f, ":", -1))))


def _only(forms: Column, pos: str, feature: Column) -> Column:
    """The one form of a part of speech with a feature (adjectives: positive), else null."""
    own = F.array_distinct(F.transform(F.filter(forms, lambda x: (x.pos == pos) & F.array_contains(x.feats, feature) & (F.lit(pos != "adj") | x.tag.endswith(":pos"))), lambda x: x.form))
    return F.when(F.size(own) == 1, F.get(own, 0))


def _has(a: Column, *pos: str) -> Column:
    return F.exists(a, lambda x: x.pos.isin(*pos))


def qualified(rows: DataFrame) -> list[str]:
    """The closed detectors of whose words the lexicon says what it has to (at most ten names)."""
    spark = rows.sparkSession
    said = [(s, form, lemma, sorted(tags.split())) for s, (_, _, words, _) in CLOSED.items() for form, lemma, tags in words]
    made = [(s, lemma, tag, form) for s, (_, _, _, forms) in CLOSED.items() for lemma, tag, form in forms]
    asked = _readings(spark.createDataFrame(said, "source string, word string, want string, tags array<string>"), "word", rows, "a")
    # Words of the table are looked up as they are written.
    pos = F.substring_index(F.get("tags", 0), ":", 1)
    of_lemma = F.array_sort(F.array_distinct(F.transform(F.filter("a", lambda x: x.lemma == F.col("want")), lambda x: x.tag)))
    lemmas = F.array_distinct(F.transform(F.filter("a", lambda x: x.pos == pos), lambda x: x.lemma))
    good = F.coalesce((of_lemma == F.col("tags")) & (lemmas == F.array("want")) & ~F.exists("a", lambda x: x.tag == "ign"), F.lit(False))
    ready = asked.groupBy("source").agg(F.every(good).alias("good"))
    forms = _forms(spark.createDataFrame(made, "source string, want string, tag string, made string"), "want", rows, "f")
    right = F.coalesce(F.array_distinct(F.transform(F.filter("f", lambda x: x.tag == F.col("tag")), lambda x: x.form)) == F.array("made"), F.lit(False))
    done = forms.groupBy("source").agg(F.every(right).alias("done"))
    return sorted(r["source"] for r in ready.join(done, "source").where("good and done").select("source").collect())


def _rows(docs: DataFrame, source: str, pattern: str, abstain=None, group: int = 1) -> DataFrame:
    """A row for each hit: doc_id, start, end, original, hit, before, after, open (a quotation is open where the hit begins)."""
    t = F.col("__text")
    hits = spans("__text", pattern, group)
    if abstain is not None:
        hits = F.filter(hits, lambda x: ~F.coalesce(abstain(Place(t, x.start, x.end, x.hit)), F.lit(True)))
    each = docs.select("doc_id", "__text", HAS_QUOTES, F.explode(hits).alias("x"))
    begin = F.col("x.end") - F.length("x.hit")
    each = each.withColumn("open", quoted(F.substring(F.col("__text"), F.lit(1), begin), "government"))
    place = Place(F.col("__text"), F.col("x.start"), F.col("x.end"))
    return each.select("doc_id", F.lit(source).alias("source"), "x.start", "x.end", "x.original", "x.hit", place.before.alias("before"), place.after.alias("after"), "open")


def _title(word: Column) -> Column:
    return word.rlike(r"\A\p{Lu}\P{Lu}+\z")


def _made(rows: DataFrame, start: Column, end: Column, original: Column, suggestion: Column) -> DataFrame:
    """Findings: doc_id and the fields."""
    own = rows.select("doc_id", start.alias("s"), end.alias("e"), original.alias("o"), suggestion.alias("g"), "source").where("g is not null and g <> o")
    out = None
    for category in ("agreement", "inflection"):
        part = own.where(F.col("source").startswith(category + ".")).select("doc_id", detect.finding(F.col("s"), F.col("e"), F.col("o"), F.col("g"), category, "suggestion", F.lit(0.9), F.col("source")).alias("f"))
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "f.*")


def _closed(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    found = []
    for source in qualified(rows):
        pattern, target = CLOSED[source][:2]
        # The guards see the whole phrase.
        whole = lambda p: wrapped(Place(p.text, p.end - F.length(p.hit), p.end), "government" if source.startswith("inflection") else "syntax")  # noqa: E731, B023
        skip = (lambda p, s=source: whole(p) | (_title(p.own) if s.startswith("inflection") else F.lit(False))) if source in _GUARDED else None
        hits = _rows(docs, source, pattern, skip)
        found.append(hits.withColumn("target", F.lit(target)))
    if not found:
        return None
    every = reduce(DataFrame.unionByName, found)
    return _made(every, F.col("start"), F.col("end"), F.col("original"), with_case(F.col("original"), F.col("target")))


def _government(docs: DataFrame, rows: DataFrame) -> DataFrame:
    end = rf"(?=\.(?![.…\p{{L}}\p{{N}}_])|[!?](?![.!?…\p{{L}}\p{{N}}_])|,(?=[ \t]+)|[ \t]+(?:{_JOIN}){NOT_BEFORE_WORD}|\z)"
    found = []
    for source, (governor, after, lemma, tag, case) in GOVERNORS.items():
        hits = _rows(docs, source, rf"(?iu){NOT_AFTER_WORD}{governor}{after}[ \t]+((?:{_W}[ \t]+)?{_W}){end}", None)
        found.append(hits.select("*", F.lit(lemma).alias("want"), F.lit(tag).alias("want_tag"), F.lit(case).alias("case")))
    own = reduce(DataFrame.unionByName, found)
    own = own.withColumn("governor", F.regexp_extract("hit", rf"\A({_W})", 1)).withColumn("noun", F.regexp_extract("original", rf"({_W})\z", 1)).withColumn("adjective", F.regexp_extract("original", rf"\A({_W})[ \t]", 1))
    lead = F.substring(F.col("before"), F.lit(1), F.length("before") - (F.length("hit") - F.length("original")))
    last, first = F.right(lead, F.lit(1)), F.left("after", F.lit(1))
    closed = reduce(or_, [(last == a) & (first == b) for a, b in ('""', "``", "„”", "“”", "«»")]) | ((F.length(lead) > 0) & first.isin(*"\"”»'`"))
    sentence = F.regexp_extract(lead, r"([^.!?]*)\z", 1)
    joined = F.lower(sentence).rlike(rf"(?:\A|[ \t])(?:{_JOIN})(?:[ \t]+(?:znów|znowu))?[ \t]+\z") | F.lower("after").rlike(rf"\A[ \t]+(?:{_JOIN}){NOT_BEFORE_WORD}")
    boundary = (F.col("source") == "inflection.government_do_sklep") & (F.lower(F.trim(sentence)) == "idę") & (F.col("governor") != "do")
    legacy = (F.col("source") == "inflection.government_szukac_klucz") & (F.col("adjective") == "") & (F.lower("noun") == "klucz") & ~F.col("after").startswith(",")
    own = own.where((legacy | ~(F.col("after").startswith(",") | closed | joined | boundary | F.col("open"))) & ~_title(F.col("noun")))
    own = _readings(_readings(_readings(own, "governor", rows, "ga"), "noun", rows, "na"), "adjective", rows, "aa")
    tags = lambda a: F.array_sort(F.array_distinct(F.transform(F.filter(a, lambda x: x.lemma == F.col("want")), lambda x: x.tag)))
    governs = (_lemma(F.col("ga"), "fin") == F.col("want")) | ((F.col("want_tag") == "prep:gen") & (_lemma(F.col("ga"), "prep") == F.col("want")))
    own = own.where(governs & (tags(F.col("ga")) == F.array("want_tag")))
    nouns = F.filter("na", lambda x: x.pos == "subst")
    feats = _feats(F.col("na"), "subst")
    common = (F.size(nouns) == 1) & (F.get(nouns, 0).labels == F.array(F.lit("nazwa_pospolita"))) & ~_has(F.col("na"), *NOMINAL) & ~F.exists(feats, lambda f: F.contains(f, F.lit(":voc:")))
    own = own.where(common & (F.size(_shapes(feats)) == 1)).withColumn("shape", F.get(_shapes(feats), 0)).withColumn("noun_lemma", _lemma(F.col("na"), "subst"))
    own = own.withColumn("feature", F.concat_ws(":", F.substring_index("shape", ":", 1), "case", F.substring_index("shape", ":", -1)))
    positive = ~F.exists(F.filter("aa", lambda x: x.pos == "adj"), lambda x: ~x.tag.endswith(":pos"))
    adjective = F.when(F.array_contains(_shapes(_feats(F.col("aa"), "adj")), F.col("shape")) & positive, _lemma(F.col("aa"), "adj"))
    own = own.withColumn("adj_lemma", F.when(~adjective.isin(NO_ADJECTIVE), adjective)).where("adjective = '' or adj_lemma is not null")
    own = _forms(_forms(own, "noun_lemma", rows, "nf"), "adj_lemma", rows, "af")
    noun = with_case(F.col("noun"), _only(F.col("nf"), "subst", F.col("feature")))
    adj = F.when(F.col("adjective") == "", F.lit("")).otherwise(with_case(F.col("adjective"), _only(F.col("af"), "adj", F.col("feature"))))
    own = own.withColumn("new_noun", noun).withColumn("new_adj", adj).where("new_noun is not null and new_adj is not null")
    moved_noun, moved_adj = F.col("new_noun") != F.col("noun"), F.col("new_adj") != F.col("adjective")
    both = moved_noun & moved_adj
    start = F.when(both | moved_adj, F.col("start")).otherwise(F.col("end") - F.length("noun"))
    stop = F.when(moved_adj & ~moved_noun, F.col("start") + F.length("adjective")).otherwise(F.col("end"))
    old = F.when(both, F.col("original")).when(moved_adj, F.col("adjective")).otherwise(F.col("noun"))
    new = F.when(both, F.concat_ws(" ", "new_adj", "new_noun")).when(moved_adj, F.col("new_adj")).otherwise(F.col("new_noun"))
    return _made(own, start, stop, old, new)


def _agreement(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """An adjective that agrees with no reading of the noun after it."""
    pattern = rf"(?iu){NOT_AFTER_WORD}(?!(?:ta|to|ten|te){NOT_BEFORE_WORD})({_W}[ \t]+{_W}){NOT_BEFORE_WORD}"
    own = _rows(docs, "agreement.nominal_group_ta_nowy_ksiazka", pattern, lambda p: quoted(p.prefix, "agreement") | wrapped(p, "agreement"))
    own = own.withColumn("adjective", F.regexp_extract("original", rf"\A({_W})", 1)).withColumn("noun", F.regexp_extract("original", rf"({_W})\z", 1))
    # The pairs of a text are many; those whose first word has no adjective reading go at the join.
    able = rows.where("pos = 'adj'").select(F.lower("form").alias("__l")).distinct()
    own = own.withColumn("__l", F.lower("adjective")).join(able, "__l", "left_semi").drop("__l")
    before, after = F.lower("before"), F.lower("after")
    demonstrative = F.regexp_extract(F.col("before"), rf"{NOT_AFTER_WORD}({_W})[ \t]+\z", 1)
    own = own.withColumn("demonstrative", F.when(F.lower(demonstrative).isin("ta", "to", "ten", "te"), demonstrative).otherwise(""))
    lead = F.lower(F.regexp_replace("before", rf"(?iu){NOT_AFTER_WORD}(?:ta|to|ten|te)[ \t]+\z", ""))
    skip = before.rlike(rf"{NOT_AFTER_WORD}(?:ta|to|ten|te)[^\p{{L}}\p{{N}}_]*[^\p{{L}}\p{{N}}_\s][^\p{{L}}\p{{N}}_]*\z") | lead.rlike(rf"{NOT_AFTER_WORD}(?:{_JOIN}|{'|'.join(PREPOSITIONS)})[ \t]+\z") | after.rlike(rf"\A[ \t]+(?:{_JOIN}){NOT_BEFORE_WORD}") | after.rlike(r"\A[ \t]*,")
    closed = (F.lower("demonstrative") == "ta") & (F.lower("adjective") == "nowy") & (F.lower("noun") == "książka")
    simple = F.col("adjective").rlike(r"\A(?:\p{Lu}+|\p{Ll}+|\p{Lu}\p{Ll}+)\z")
    own = own.where(~skip & ~closed & simple)
    own = _readings(_readings(_readings(own, "adjective", rows, "aa"), "noun", rows, "na"), "demonstrative", rows, "da")
    nouns = F.filter("na", lambda x: x.pos == "subst")
    common = F.forall(nouns, lambda x: x.labels == F.array(F.lit("nazwa_pospolita"))) & ~_has(F.col("na"), *VERBAL)
    positive = ~F.exists(F.filter("aa", lambda x: x.pos == "adj"), lambda x: ~x.tag.endswith(":pos"))
    own = own.withColumn("adj_lemma", F.when(positive, _lemma(F.col("aa"), "adj"))).where(common & _lemma(F.col("na"), "subst").isNotNull() & ~F.col("adj_lemma").isin(NO_ADJECTIVE))
    target = F.when(F.col("demonstrative") == "", _feats(F.col("na"), "subst")).when(_lemma(F.col("da"), "adj") == "ten", F.array_intersect(_feats(F.col("na"), "subst"), _feats(F.col("da"), "adj")))
    own = own.withColumn("target", target).where((F.size("target") == 1) & ~F.arrays_overlap("target", _feats(F.col("aa"), "adj")))
    own = _forms(own, "adj_lemma", rows, "af")
    return _made(own, F.col("start"), F.col("start") + F.length("adjective"), F.col("adjective"), with_case(F.col("adjective"), _only(F.col("af"), "adj", F.get("target", 0))))


def _present(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """A verb in the present whose person or number is not that of the pronoun before it."""
    names = "|".join(sorted(PRONOUNS, key=len, reverse=True))
    pattern = rf"(?iu){NOT_AFTER_WORD}(?:{names})(?:[ \t]+|[ \t]*[,;:—–-][ \t]+)(?:nie[ \t]+)?({_W}){NOT_BEFORE_WORD}"
    begin = lambda p: Place(p.text, p.end - F.length(p.hit), p.end)
    own = _rows(docs, "agreement.subject_verb_present", pattern, lambda p: quoted(begin(p).prefix, "agreement"))
    own = own.withColumn("subject", F.regexp_extract("hit", rf"\A({_W})", 1))
    lead = F.lower(F.substring(F.col("before"), F.lit(1), F.length("before") - (F.length("hit") - F.length("original"))))
    after, subject, verb = F.lower("after"), F.lower("subject"), F.lower("original")
    joins = f"{_JOIN}|a|ale|lecz|natomiast"
    copulas = [f"{s} {v}" for s, (_, wrong) in COPULA.items() for v in wrong.split()] + ["ja jest"] + [f"{s} {v}" for s in ("ono", "oni", "one", "my", "wy") for v in ("jesteśmy", "jesteście")]
    skip = lead.rlike(rf"{NOT_AFTER_WORD}(?:{joins})[ \t]+\z") | lead.rlike(r";[ \t]*\z") | after.rlike(rf"\A[ \t]*(?:[,;:][ \t]*)?(?:{joins}){NOT_BEFORE_WORD}") | F.col("hit").rlike(r"\p{M}") | F.col("after").rlike(r"\A\p{M}")
    taken = F.concat_ws(" ", subject, verb).isin(copulas) | ((subject == "my") & (verb == "czyta") & (after.rlike(r"\A[ \t]*(?:książkę|książke|gazetę|gazete)[.!?,;:]*(?:\s|\z)") | (F.trim("after") == ""))) | ((subject == "oni") & (verb == "czyta") & (F.col("before") == "Oni ") & (F.col("after") == " książkę."))
    cased = F.col("subject").rlike(r"\A(?:\p{Lu}+|\p{Lu}\p{Ll}+)\z") & F.col("original").rlike(r"\A(?:\p{Lu}+|\p{Ll}+|\p{Lu}\p{Ll}+)\z")
    own = own.where(~skip & ~taken & cased)
    own = own.withColumn("capital", F.concat(F.upper(F.left("subject", F.lit(1))), F.lower(F.substring("subject", 2, 99))))
    words = _readings(_readings(own, "capital", rows, "sa"), "original", rows, "va")
    # A pronoun is listed in lower case; it is looked up as it is written or so.
    words = _readings(words.withColumn("plain", F.lower("subject")), "plain", rows, "sb").withColumn("sa", F.coalesce("sa", "sb"))
    facts = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for s, f in PRONOUNS.items() for x in (s, f[k])]), F.lower("subject"))
    wanted = F.try_element_at(F.create_map(*[x for s, f in PRONOUNS.items() for x in (F.lit(s), F.array(*map(F.lit, f[3])))]), F.lower("subject"))
    pronouns = F.filter("sa", lambda x: x.pos.startswith("ppron"))
    others = F.filter("sa", lambda x: ~x.pos.startswith("ppron"))
    known = (F.array_sort(F.transform(pronouns, lambda x: x.tag)) == F.array_sort(wanted)) & (F.array_distinct(F.transform(pronouns, lambda x: x.lemma)) == F.array(facts(2))) & F.forall(others, lambda x: (x.pos == "adj") & (x.lemma == "on:A") & (facts(2) == "on:S"))
    finite = F.filter("va", lambda x: x.pos == "fin")
    clear = (F.size(finite) == 1) & F.get(finite, 0).tag.rlike(r"\Afin:(?:sg|pl):(?:pri|sec|ter):imperf\z") & ~_has(F.col("va"), "ign") & F.forall("va", lambda x: x.pos.isin("fin", "adj", "subst"))
    alone = (F.size("va") == 1) | F.lower("after").rlike(rf"\A[ \t]+(?:w|we|na|do|z|ze|od|u|o|po|przy|pod|nad|za|przez|między)[ \t]+{_W}")
    words = words.where(known & clear & alone).withColumn("verb_lemma", F.get(finite, 0).lemma).withColumn("tag", F.concat_ws(":", F.lit("fin"), facts(0), facts(1), F.lit("imperf")))
    words = _forms(words, "verb_lemma", rows, "vf")
    right = F.array_distinct(F.transform(F.filter("vf", lambda x: x.tag == F.col("tag")), lambda x: x.form))
    return _made(words, F.col("start"), F.col("end"), F.col("original"), F.when(F.size(right) == 1, with_case(F.col("original"), F.get(right, 0))))


def findings(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A row for each finding of the detectors with morphology: doc_id and its fields. Another version of the lexicon, or an empty one, finds nothing; null and empty texts have no findings."""
    rows = prepared(lexicon)
    own = detect.once(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")), HAS_QUOTES, F.col("__text").rlike(ANY_QUOTE))
    parts = [p for p in (_closed(own, rows), _government(own, rows), _agreement(own, rows), _present(own, rows)) if p is not None]
    return reduce(DataFrame.unionByName, parts).distinct()


def all_findings(docs: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """Findings of all 63 detectors; sources or categories may be given as in detect.analyze()."""
    more = findings(docs, lexicon)
    sources, categories = options.get("sources"), options.get("categories")
    tests = [F.col("confidence") >= options.get("minimum_confidence", 0.0)] + ([F.col("source").isin(list(sources))] if sources is not None else []) + ([F.col("category").isin(list(categories))] if categories is not None else [])
    return detect.findings(docs, **options).unionByName(more.where(reduce(and_, tests)))


assert set(GOVERNORS) | set(CLOSED) | {"agreement.subject_verb_present"} == set(MORPHOLOGY)
