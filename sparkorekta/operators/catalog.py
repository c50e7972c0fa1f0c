"""The detectors as data: what they match, what they suggest, when they abstain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import LETTER, LOWER, NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE, UPPER, WORD, Place, let, literal_guard, lookup, quoted, with_case, wrapped
from .segment import sentences_of

Guard = Callable[[Place], Column]


@dataclass(frozen=True)
class Rule:
    """pattern: the span is `group` and ends where the match ends. suggest(original, hit). abstain(place of the span)."""

    source: str
    category: str
    operation: str
    pattern: str
    group: int
    suggest: Callable[[Column, Column], Column]
    abstain: Guard | None = None
    confidence: float = 0.9
    severity: str = "suggestion"
    single_sentence: bool = False
    source_of: Callable[[Column], Column] | None = None
    #: A closed template: what stands between repeats in a sentence (None: anything), and whether a full stop has to end it.
    template: tuple[str | None, bool] | None = None
    #: Lower-case strings of which the text has to hold one; a cheap test before the pattern (none: always tried).
    gate: tuple[str, ...] = ()


#: Typed form, corrected form, source, confidence of the closed literals.
LITERALS = [
    ("jestes", "jesteś", "jestes", 0.96),
    ("czyby", "czy by", "czyby", 0.98),
    ("coniemiara", "co niemiara", "co_niemiara", 0.98),
    ("napewno", "na pewno", "napewno", 0.98),
    ("wlasnie", "właśnie", "wlasnie", 0.97),
    ("zeby", "żeby", "zeby", 0.98),
    ("wogole", "w ogóle", "wogole", 0.98),
    ("wogóle", "w ogóle", "wogole_diacritic", 0.98),
    ("narazie", "na razie", "narazie", 0.98),
    ("wziasc", "wziąć", "wziasc", 0.98),
    ("wziąść", "wziąć", "wziasc_diacritic", 0.98),
    ("conajmniej", "co najmniej", "conajmniej", 0.98),
    ("poprostu", "po prostu", "poprostu", 0.98),
    ("pozatym", "poza tym", "pozatym", 0.98),
    ("przedewszystkim", "przede wszystkim", "przedewszystkim", 0.98),
    ("wkońcu", "w końcu", "wkoncu", 0.98),
    ("wkoncu", "w końcu", "wkoncu", 0.98),
    ("spowrotem", "z powrotem", "spowrotem", 0.98),
    ("tymbardziej", "tym bardziej", "tymbardziej", 0.98),
    ("naprawde", "naprawdę", "naprawde", 0.98),
    ("niejestem", "nie jestem", "nie_byc_joint", 0.98),
    ("niejestes", "nie jesteś", "nie_byc_joint", 0.98),
    ("niebędzie", "nie będzie", "nie_byc_joint", 0.98),
    ("niebedzie", "nie będzie", "nie_byc_joint", 0.98),
    ("niebył", "nie był", "nie_byc_joint", 0.98),
    ("niebyl", "nie był", "nie_byc_joint", 0.98),
    ("poszłem", "poszedłem", "poszlem", 0.98),
    ("włanczać", "włączać", "wlanczac", 0.98),
    ("wlanczac", "włączać", "wlanczac", 0.98),
    ("wyłanczać", "wyłączać", "wlanczac", 0.98),
    ("wylanczac", "wyłączać", "wlanczac", 0.98),
]
#: The right form of to be after a subject, and the forms that are wrong after it.
COPULA = {
    "ona": ("jest", "jestem jesteś jestes jestesz jesteśmy jesteście są"),
    "on": ("jest", "jestem jesteś jestes jesteśmy jesteście są"),
    "ono": ("jest", "jestem jesteś jestes są"),
    "oni": ("są", "jestem jesteś jest jestes jesteście"),
    "one": ("są", "jestem jesteś jest jestes"),
    "ty": ("jesteś", "jestem jest"),
    "my": ("jesteśmy", "jestem jesteś jestes"),
    "wy": ("jesteście", "jestem jesteś jestes"),
}
#: Closed word sets of the detectors.
CALENDAR = "poniedziałek wtorek środa czwartek piątek sobota niedziela styczeń luty marzec kwiecień maj czerwiec lipiec sierpień wrzesień październik listopad grudzień".split()
HEADS = "języka język literatury historii kultury narodu".split()
NATIONAL = "polskiego polska polski angielskiego francuskiego niemieckiego rosyjskiego".split()
OPENERS = "potem później następnie jednak natomiast dlatego wtedy teraz tutaj tam".split()
NOT_SENTENCE_END = "oprac porówn miejsc wspomn przekł właśc ewent rozdz załącz".split()
REPORTING = "wiem myślę sądzę uważam mówię powiedział powiedziałam wiemy".split()
PURPOSE = "chcę pragnę proszę chcemy".split()
NO_CAUSE_AFTER = "no a i oraz ale lecz czy to więc lub albo ani bądź nie tylko jedynie właśnie jak jako niż".split()


def _cases(words: list[str]) -> str:
    return "|".join(x for w in words for x in (w[0].upper() + w[1:], w, w.upper()))


def _const(text: str) -> Callable[[Column, Column], Column]:
    return lambda o, h: F.lit(text)


def _copula(compat: bool) -> Rule:
    pairs = {f"{s} {v}": good for s, (good, wrong) in COPULA.items() for v in wrong.split()}
    verbs = "jestem|jestes|jestesz|jesteś|jesteśmy|jesteście|są|jest"
    # compat keeps the quirk that the first fitting verb wins even inside a longer word.
    pattern = rf"(?iu){NOT_AFTER_WORD}({'|'.join(COPULA)})[\s\p{{Z}}]+({verbs}){'' if compat else NOT_BEFORE_WORD}"
    key = lambda h: F.regexp_replace(F.lower(h), r"[\s\p{Z}]+", " ")
    return Rule("agreement.copula", "agreement", "replace.copula_form", pattern, 2, lambda o, h: with_case(o, lookup(pairs, key(h))), None, 0.93)


def _co_guard(p: Place) -> Column:
    """Where `coniemiara` is no prose: odd neighbours, names of goods and firms, words about words, operators, a capital inside a sentence."""
    last, first = F.regexp_extract(p.before, rf"(\S){SPACE}*\z", 1), F.regexp_extract(p.after, rf"\A{SPACE}*(\S)", 1)
    safe = r".,;:!?…()\[\]{}<>\-–—'\"`„”“«»‘’‹›「」『』〈〉《》"
    odd = rf"[\p{{C}}\p{{M}}\p{{S}}\p{{P}}&&[^{safe}\n\r]]"
    # Words before and after which the form is a name or a mention.
    about = r"(?iu)(?:\A|[\s(\[{:;,.!?])(?:napis|napisano|napisy|słowo|wyraz|forma|termin|przykład|przyklad|pisownia|marka|markę|nazwa\s+produktu|produkt(?:u|owa|owej)?)\s*[:–—-]?\s*\z"
    firm = r"(?iu)\A\s+(?:sp\.\s+z\s+o\.o\.|s\.a\.|spółka\s+z\s+o\.o\.)"
    operator = r"[=|^+*/%<>→←⇐⇒↔±×÷&~\p{Sm}]"
    title = p.own.rlike(r"\A\p{Lu}\p{Ll}+\z")
    mixed = ~p.own.rlike(r"\A(?:\p{Ll}+|\p{Lu}+|\p{Lu}\p{Ll}+)\z")
    return p.before.rlike(odd + r"\z") | p.after.rlike(r"\A" + odd) | p.before.rlike(about) | p.after.rlike(firm) | last.rlike(operator) | first.rlike(operator) | mixed | (title & (last != "") & ~last.rlike("[.!?…]"))


def _arcy_guard(p: Place) -> Column:
    """Abstains at the beginning of a sentence, next to brackets, quotes, commas and line breaks, inside brackets and before marks that join."""
    gap = F.regexp_extract(p.before, rf"({SPACE}*)\z", 1)
    lead = F.regexp_replace(p.before, rf"(?:{SPACE}|['\"”’»›)\]}}\p{{Pe}}\p{{Pf}}])+\z", "")
    opened = p.prefix.rlike(r"[(\[{<][^)\]}>]*\z") | quoted(p.prefix, "agreement")
    return (lead == "") | lead.rlike(r"[.!?…,;:]\z") | gap.rlike(r"[\r\n\x85\u2028\u2029]") | p.before.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]\z") | p.after.rlike(r"\A[,;:\p{M}\p{Ps}\p{Pe}\p{Pi}\p{Pf}<>'\"`ʼ′]") | opened | literal_guard(p)


def _shouted_clause(p: Place) -> Column:
    """Whether the sentence around the place is all capitals up to its one full stop, after at most a lead-in with a colon."""
    own = F.get(F.filter(sentences_of(p.text), lambda s: (s.start < p.start) & (p.start < s.end)), 0)
    good = let(own, lambda s: F.substring(s.text, F.lit(1), p.start - s.start).rlike(rf"\A(?:[{LETTER}\s]*:)?[{UPPER}\s]*\z") & F.substring(s.text, p.start - s.start + 1, F.lit(1 << 30)).rlike(rf"\A[{UPPER}\s]+\.\s*\z"))
    return F.coalesce(good, F.lit(False))


def _causal(p: Place) -> Column:
    word = F.lower(F.regexp_replace(F.regexp_extract(p.before, r"(\S+)\z", 1), rf"[^\p{{L}}\p{{N}}_]+\z", ""))
    shouted = p.after.rlike(rf"\A (?:BO|PONIEWAŻ|GDYŻ) [{UPPER}]") & ~p.after.rlike(rf"\A (?:bo|ponieważ|gdyż) [{LOWER}]")
    return word.isin(NO_CAUSE_AFTER) | quoted(p.prefix) | F.when(shouted, ~_shouted_clause(p)).otherwise(F.lit(False))


def rules(compat: bool = False) -> list[Rule]:
    """The detectors that need no morphology. Patterns and words that have to match as they are: fixed values."""
    q = lambda p: quoted(p.prefix)
    agree = lambda p: wrapped(p, "agreement") | quoted(p.prefix, "agreement")
    whole = lambda p: literal_guard(Place(p.text, p.end - F.length(p.hit), p.end))
    fixed = {t: c for t, c, _, _ in LITERALS}
    names = {t: f"spelling.{s}" for t, _, s, _ in LITERALS}
    inserted = lambda text: dict(group=1, suggest=_const(text))
    again = rf"{SPACE}+(?:i znów|I ZNÓW){SPACE}+"
    same_sentence = r"(?!\s*?\r?\n[ \t]*\r?\n)"
    literal = lambda p: literal_guard(p) | ((F.lower(p.own) == "coniemiara") & _co_guard(p))
    out = [
        _copula(compat),
        Rule("agreement.copula_ja", "agreement", "replace.copula_person", rf"{NOT_AFTER_WORD}(?:Ja|ja|JA)[\s\p{{Z}}]+(jest|JEST){NOT_BEFORE_WORD}", 1, lambda o, h: with_case(o, F.lit("jestem")), agree),
        Rule("agreement.te_zdanie", "agreement", "replace.demonstrative_neuter_phrase", rf"(?iu){NOT_AFTER_WORD}te[ \t]+zdanie{NOT_BEFORE_WORD}", 0, lambda o, h: F.concat(with_case(F.left(o, F.lit(2)), F.lit("to")), F.substring(o, 3, 1 << 30)), None, 0.98, "error"),
        Rule("agreement.te_neuter_noun", "agreement", "replace.pronoun_gender", rf"{NOT_AFTER_WORD}(?:(Te|te|TE)(?=[ \t]+(?:dziecko|okno|słońce|morze){NOT_BEFORE_WORD})|(?:TE)(?=[ \t]+(?:DZIECKO|OKNO|SŁOŃCE|MORZE){NOT_BEFORE_WORD}))", 0, lambda o, h: with_case(o, F.lit("to")), lambda p: agree(p) | p.after.rlike(r"\A[ \t]+\p{L}+[ \t]*,")),
        Rule("inflection.negated_widziec", "inflection", "replace.negated_government_form", rf"{NOT_AFTER_WORD}(?:(?:Nie|nie) widzę (?=samochód)|NIE WIDZĘ (?=SAMOCHÓD))(samochód|SAMOCHÓD){NOT_BEFORE_WORD}", 1, lambda o, h: with_case(o, F.lit("samochodu")), template=(again, True)),
        Rule("inflection.negated_miec_czas", "inflection", "replace.governed_form", rf"{NOT_AFTER_WORD}(?:(?:Nie|nie) mam (?=czas)|NIE MAM (?=CZAS))(czas|CZAS){NOT_BEFORE_WORD}", 1, lambda o, h: with_case(o, F.lit("czasu")), template=(again, True)),
        Rule("inflection.numeral_five_genitive_plural", "inflection", "replace.governed_form", rf"{NOT_AFTER_WORD}(?:Pięć|pięć|PIĘĆ){SPACE}+(książki|KSIĄŻKI)(?={SPACE})", 1, lambda o, h: with_case(o, F.lit("książek")), template=(None, False)),
        Rule("spelling.*", "spelling", "replace.common_typo", rf"(?iu){NOT_AFTER_WORD}(?:{'|'.join(sorted(fixed, key=len, reverse=True))}){NOT_BEFORE_WORD}", 0, lambda o, h: with_case(o, lookup(fixed, F.lower(o))), literal, 0.98, source_of=lambda o: lookup(names, F.lower(o))),
        Rule("spelling.arcy_prefix", "spelling", "replace.prefix_hyphenation", rf"{NOT_AFTER_WORD}arcy [{UPPER}][{LETTER}]*(?![\p{{L}}\p{{N}}_-])", 0, lambda o, h: F.replace(o, F.lit(" "), F.lit("-")), _arcy_guard, 0.95),
        Rule("spelling.month_weekday_lowercase", "spelling", "replace.case", rf"{NOT_AFTER_WORD}(?:w|we) ([{UPPER}][{LOWER}]+){NOT_BEFORE_WORD}", 1, lambda o, h: F.lower(o), lambda p: ~F.lower(p.own).isin(CALENDAR) | whole(p) | p.after.rlike(rf"\A{SPACE}*\p{{Lu}}")),
        Rule("spelling.proper_adjective_lowercase", "spelling", "replace.case", rf"{NOT_AFTER_WORD}(?:{'|'.join(HEADS)}) ([{UPPER}][{LOWER}]+){NOT_BEFORE_WORD}", 1, lambda o, h: F.lower(o), lambda p: ~F.lower(p.own).isin(NATIONAL) | whole(p)),
        Rule("spelling.sentence_initial_capital", "spelling", "replace.case", rf"(?<![{LETTER}])[{LETTER}]{{6,}}\. ([{LOWER}]+){NOT_BEFORE_WORD}", 1, lambda o, h: F.concat(F.upper(F.left(o, F.lit(1))), F.substring(o, 2, 1 << 30)), lambda p: ~p.own.isin(OPENERS) | F.lower(F.substring_index(p.hit, ".", 1)).isin(NOT_SENTENCE_END)),
        Rule("syntax.comma_space", "punctuation", "normalize.comma_spacing", rf"(?<!\p{{Nd}})(?<!(?:\A|[ ])(?iu:itp|np|tj|m\.in|i\.e|np\.)),(?=[{LETTER}])", 0, _const(", ")),
        Rule("syntax.duplicate_comma", "punctuation", "remove.duplicate_comma", rf"(?<=[{LETTER}]),(,)(?!,)(?={SPACE}+[{LETTER}])", 1, _const(""), q),
        Rule("syntax.initial_conditional_comma", "syntax", "insert.conditional_clause_comma", r"\A(?:Jeśli pada(?= zostaję w domu\.\z)|jeśli pada(?= zostaję w domu\.\z)|JEŚLI PADA(?= ZOSTAJĘ W DOMU\.\z))()", **inserted(",")),
        Rule("syntax.initial_temporal_comma", "syntax", "insert.temporal_clause_comma", rf"(?iu){NOT_AFTER_WORD}(?:Gdy pada|Kiedy pada|Kiedy wieje|Kiedy wrócisz)()(?= \S)", **inserted(","), abstain=q, single_sentence=True),
        Rule("syntax.comma_before_ze_reporting", "syntax", "insert.reporting_clause_comma", rf"{NOT_AFTER_WORD}(?:{_cases(REPORTING)})()(?= (?:że|Że|ŻE){same_sentence}{SPACE}+\S)", **inserted(","), abstain=q),
        Rule("syntax.comma_before_zeby_purpose", "syntax", "insert.purpose_clause_comma", rf"{NOT_AFTER_WORD}(?:{_cases(PURPOSE)})()(?= (?:żeby|Żeby|ŻEBY|żebyś|Żebyś|ŻEBYŚ){same_sentence}{SPACE}+\S)", **inserted(","), abstain=q),
        Rule("syntax.comma_before_bo", "syntax", "insert.causal_clause_comma", rf"(?:[{LETTER}](?= (?:bo|ponieważ|gdyż) [{LOWER}])|[{UPPER}](?= (?:BO|PONIEWAŻ|GDYŻ) [{UPPER}]))()", **inserted(","), abstain=_causal),
        Rule("syntax.list_space", "syntax", "normalize.list_marker_spacing", r"(?:\A|(?<=\n))(?:[0-9]+\.(?![0-9])|-|\*)()(?=\S)", **inserted(" ")),
        Rule("syntax.missing_correlative", "syntax", "insert.correlative", rf"\A\s*Im{NOT_BEFORE_WORD}[^.!?]*?,\s+()(?=bardziej{NOT_BEFORE_WORD})", **inserted("tym "), single_sentence=True),
        Rule("syntax.missing_destination_preposition", "syntax", "insert.destination_preposition", r"\A(?:[Pp]ojechałem (?=Warszawy\.\z)|POJECHAŁEM (?=WARSZAWY\.\z))()", 1, lambda o, h: F.when(h.rlike(r"\A\p{Lu}{2}"), F.lit("DO ")).otherwise("do ")),
        Rule("syntax.missing_reflexive", "syntax", "insert.reflexive_pronoun", rf"\A{SPACE}*(?:(?:On|Ona|Ono){SPACE}+boi|Nie{SPACE}+spodziewaliśmy){NOT_BEFORE_WORD}()(?={SPACE}+(?!{SPACE}|się[.,!?;:]*(?:{SPACE}|\z))\S)", **inserted(" się"), single_sentence=True),
        Rule("syntax.quote_space", "punctuation", "normalize.quote_spacing", rf"(?<=\S)[\"“”„](?=[{LETTER}])", 0, lambda o, h: F.concat(o, F.lit(" "))),
        Rule("syntax.sentence_space", "punctuation", "normalize.sentence_spacing", rf"(?<!\p{{Nd}})(?<!(?:\A|[^\p{{L}}\p{{N}}_])(?:np|itp|tj))\.(?=[{UPPER}])", 0, _const(". ")),
        Rule("punctuation.abbreviation_dot", "punctuation", "insert.abbreviation_dot", rf"(?iu){NOT_AFTER_WORD}(?:itp|itd|tzn)()(?={SPACE}+\S)", **inserted("."), abstain=q),
    ]
    return [replace(r, gate=GATES.get(r.source, ())) for r in out]


GATES = {
    "agreement.copula": ("jest", "są"),
    "agreement.copula_ja": ("jest",),
    "agreement.te_zdanie": ("zdanie",),
    "agreement.te_neuter_noun": ("dziecko", "okno", "słońce", "morze"),
    "inflection.negated_widziec": ("samochód",),
    "inflection.negated_miec_czas": (" czas",),
    "inflection.numeral_five_genitive_plural": ("książki",),
    "spelling.*": tuple(t for t, *_ in LITERALS),
    "spelling.arcy_prefix": ("arcy ",),
    "spelling.month_weekday_lowercase": tuple(CALENDAR),
    "spelling.proper_adjective_lowercase": tuple(NATIONAL),
    "spelling.sentence_initial_capital": tuple(OPENERS),
    "syntax.duplicate_comma": (",,",),
    "syntax.initial_conditional_comma": ("zostaję w domu",),
    "syntax.initial_temporal_comma": ("gdy pada", "kiedy "),
    "syntax.comma_before_ze_reporting": (" że",),
    "syntax.comma_before_zeby_purpose": (" żeby",),
    "syntax.comma_before_bo": (" bo ", " ponieważ ", " gdyż "),
    "syntax.missing_correlative": ("bardziej",),
    "syntax.missing_destination_preposition": ("warszawy",),
    "syntax.missing_reflexive": ("boi", "spodziewaliśmy"),
    "syntax.quote_space": ('"', "“", "”", "„"),
    "punctuation.abbreviation_dot": ("itp", "itd", "tzn"),
}

#: All detectors in the order of registration.
SOURCES = (
    "agreement.copula agreement.copula_ja agreement.te_zdanie agreement.te_neuter_noun agreement.nominal_group_te_duze_okno agreement.nominal_group_ta_nowy_ksiazka "
    "agreement.subject_verb_oni_czyta agreement.subject_verb_my_czyta agreement.subject_verb_present "
    "inflection.negated_widziec inflection.negated_widziec_nominal_group inflection.negated_miec_czas inflection.negated_lubic_kawe inflection.przygladac_sie_nowy_budynek "
    "inflection.government_potrzebowac_pomoc inflection.government_szukac_klucz inflection.government_sluchac_radio inflection.government_uzywac_telefon "
    "inflection.government_interesowac_sie_historia inflection.government_byc_nauczyciel inflection.government_do_sklep inflection.government_ufac_lekarz inflection.numeral_five_genitive_plural "
    "spelling.jestes spelling.czyby spelling.arcy_prefix spelling.co_niemiara spelling.napewno spelling.wlasnie spelling.zeby spelling.wogole spelling.wogole_diacritic spelling.narazie spelling.wziasc "
    "spelling.wziasc_diacritic spelling.conajmniej spelling.poprostu spelling.pozatym spelling.przedewszystkim spelling.wkoncu spelling.spowrotem spelling.tymbardziej spelling.naprawde "
    "spelling.nie_byc_joint spelling.poszlem spelling.wlanczac spelling.month_weekday_lowercase spelling.proper_adjective_lowercase spelling.sentence_initial_capital "
    "syntax.comma_space syntax.duplicate_comma syntax.initial_conditional_comma syntax.initial_temporal_comma syntax.comma_before_ze_reporting syntax.comma_before_zeby_purpose syntax.comma_before_bo "
    "syntax.list_space syntax.missing_correlative syntax.missing_destination_preposition syntax.missing_reflexive syntax.quote_space syntax.sentence_space punctuation.abbreviation_dot"
).split()
#: Versions of behaviour other than 1.0, and the dictionary that qualifies the detectors with morphology.
VERSIONS = {"agreement.te_neuter_noun": "2.0", "inflection.negated_widziec": "2.0", "syntax.comma_before_bo": "3.0", "agreement.nominal_group_ta_nowy_ksiazka": "2.1", "agreement.subject_verb_present": "1.8"}
LEXICON_VERSION = "pl.sgjp.sgjp-2026.06.01"
#: Detectors that need the optional morphology provider; it is absent here, so they abstain.
MORPHOLOGY = (
    "agreement.nominal_group_te_duze_okno agreement.nominal_group_ta_nowy_ksiazka agreement.subject_verb_oni_czyta agreement.subject_verb_my_czyta "
    "agreement.subject_verb_present inflection.negated_widziec_nominal_group inflection.negated_lubic_kawe inflection.przygladac_sie_nowy_budynek "
    "inflection.government_potrzebowac_pomoc inflection.government_szukac_klucz inflection.government_sluchac_radio inflection.government_uzywac_telefon "
    "inflection.government_interesowac_sie_historia inflection.government_byc_nauczyciel inflection.government_do_sklep inflection.government_ufac_lekarz"
).split()
#: Sources whose findings are applied without asking, at a confidence of 0.9 or more.
AUTOMATIC = "agreement.copula spelling.jestes spelling.wlasnie spelling.zeby syntax.comma_space syntax.list_space syntax.quote_space syntax.sentence_space".split()


def behavior_version(source: str) -> str:
    return f"{source.replace('.', '-').replace('_', '-')}/{VERSIONS.get(source, '1.0')}"


def entries(compat: bool = False) -> list[tuple]:
    """A row for each detector: ord, source, category, operation, behavior_version, severity, confidence, needs_morphology."""
    known = {}
    for r in rules(compat):
        for source, sure in [(f"spelling.{s}", c) for _, _, s, c in LITERALS] if r.source_of else [(r.source, r.confidence)]:
            spaced = r.source_of and source in ("spelling.czyby", "spelling.co_niemiara")
            known[source] = (r.category, "replace.closed_literal_spacing" if spaced else r.operation, r.severity, sure)
    out = []
    for k, source in enumerate(SOURCES):
        category, operation, severity, sure = known.get(source, (source.split(".")[0], OPERATIONS.get(source, "replace.governed_form"), "suggestion", 0.9))
        out.append((k, source, category, operation, behavior_version(source), severity, sure, source in MORPHOLOGY))
    return out


#: Operations of detectors with morphology, where they aren't replace.governed_form.
OPERATIONS = {"agreement.nominal_group_te_duze_okno": "replace.demonstrative_neuter_phrase", "agreement.nominal_group_ta_nowy_ksiazka": "replace.adjective_gender", "agreement.subject_verb_oni_czyta": "replace.subject_verb_person_number", "agreement.subject_verb_my_czyta": "replace.subject_verb_person_number", "agreement.subject_verb_present": "replace.subject_verb_person_number", "inflection.negated_widziec_nominal_group": "replace.negated_government_form"}
#: Fixed value: version of the automatic policy.
POLICY_VERSION = "1.2"


def policy() -> list[tuple[str, str, str, str, str, float]]:
    """Rows of the automatic policy: source, category, operation, behavior_version, policy_version, minimum_confidence."""
    return [(e[1], e[2], e[3], e[4], POLICY_VERSION, 0.9) for e in entries() if e[1] in AUTOMATIC]
