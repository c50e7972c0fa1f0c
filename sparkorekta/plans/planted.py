"""Sentences that hold one error each, and what is to be found in them: source, start, end, suggestion."""

from __future__ import annotations

from ..operators.catalog import LITERALS

#: Errors that stand anywhere in a text.
IN_TEXT = [
    ("To mówi, że Ty jest zmęczony.", [("agreement.copula", 15, 19, "jesteś")]),
    ("Wiadomo, Ja jest tutaj.", [("agreement.copula_ja", 12, 16, "jestem")]),
    ("Otóż te  zdanie kończy tekst.", [("agreement.te_zdanie", 5, 15, "to  zdanie")]),
    ("Otóż te morze szumi.", [("agreement.te_neuter_noun", 5, 7, "to")]),
    *[(f"Otóż {typed} tak było.", [(f"spelling.{source}", 5, 5 + len(typed), right)]) for typed, right, source, _ in LITERALS],
    ("To jest arcy Europa dzisiaj.", [("spelling.arcy_prefix", 8, 19, "arcy-Europa")]),
    ("Wrócę we Wtorek rano.", [("spelling.month_weekday_lowercase", 9, 15, "wtorek")]),
    ("Uczę się języka Polskiego.", [("spelling.proper_adjective_lowercase", 16, 25, "polskiego")]),
    ("Wczoraj skończyłem. teraz odpocznę.", [("spelling.sentence_initial_capital", 20, 25, "Teraz")]),
    ("Tak,jasne.", [("syntax.comma_space", 3, 4, ", ")]),
    ("Tak,, jasne.", [("syntax.duplicate_comma", 4, 5, "")]),
    ("Teraz myślę że zdążę.", [("syntax.comma_before_ze_reporting", 11, 11, ",")]),
    ("Bardzo proszę żeby wrócił.", [("syntax.comma_before_zeby_purpose", 13, 13, ",")]),
    ("Długo śpię bo mogę.", [("syntax.comma_before_bo", 10, 10, ",")]),
    ('Rzekł"zatem', [("syntax.quote_space", 5, 6, '" ')]),
    ("Koniec.Nowe.", [("syntax.sentence_space", 6, 7, ". ")]),
    ("Noże itp rzeczy.", [("punctuation.abbreviation_dot", 8, 8, ".")]),
    ("Otóż Zeby,tak.", [("spelling.zeby", 5, 9, "Żeby"), ("syntax.comma_space", 9, 10, ", ")]),
    ("Zwykłe zdanie bez błędów.", []),
    ("Pisz na zeby@a.pl oraz www.zeby.pl i zeby_x.", []),
]
#: And errors that need a sentence or the whole input to themselves.
PLANTED = [
    *IN_TEXT,
    ("Nie widzę samochód.", [("inflection.negated_widziec", 10, 18, "samochodu")]),
    ("Nie mam czas.", [("inflection.negated_miec_czas", 8, 12, "czasu")]),
    ("Pięć książki stoi tam.", [("inflection.numeral_five_genitive_plural", 5, 12, "książek")]),
    ("Jeśli pada zostaję w domu.", [("syntax.initial_conditional_comma", 10, 10, ",")]),
    ("Gdy pada zostaję w domu.", [("syntax.initial_temporal_comma", 8, 8, ",")]),
    ("-raz\n-dwa", [("syntax.list_space", 1, 1, " "), ("syntax.list_space", 6, 6, " ")]),
    ("Im więcej ćwiczę, bardziej rozumiem.", [("syntax.missing_correlative", 18, 18, "tym ")]),
    ("Pojechałem Warszawy.", [("syntax.missing_destination_preposition", 11, 11, "do ")]),
    ("Ona boi psa.", [("syntax.missing_reflexive", 7, 7, " się")]),
    ("Ona boi się.", []),
    ("Nie mam czas i sił.", []),
]


def expected_rows(planted: list[tuple]) -> list[tuple]:
    """number of the sentence, source, start, end, suggestion."""
    return [(k, *f) for k, (_, found) in enumerate(planted) for f in found]
