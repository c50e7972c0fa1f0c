"""A small lexicon for queries and tests: form, lemma, tag and, for common nouns, the label."""

from __future__ import annotations

from ..operators.catalog import LEXICON_VERSION

_ADJECTIVE = "adj:sg:acc:m3:pos adj:sg:nom.voc:m1.m2.m3:pos"
_FIRST = "fin:sg:pri:imperf"
#: Forms with lemma and tags.
FORMS = [
    ("Te", "ten", "adj:pl:acc:m2.m3.f.n:pos adj:pl:nom.voc:m2.m3.f.n:pos"), ("to", "ten", "adj:sg:nom.voc:n:pos"), ("Ta", "ten", "adj:sg:nom.voc:f:pos"), ("ta", "ten", "adj:sg:nom.voc:f:pos"), ("ten", "ten", "adj:sg:nom.voc:m1.m2.m3:pos"),
    ("duże", "duży", "adj:pl:acc:m2.m3.f.n:pos adj:pl:nom.voc:m2.m3.f.n:pos adj:sg:acc:n:pos adj:sg:nom.voc:n:pos"), ("duży", "duży", _ADJECTIVE), ("dużego", "duży", "adj:sg:gen:m1.m2.m3.n:pos"), ("duża", "duży", "adj:sg:nom.voc:f:pos"),
    ("nowy", "nowy:A", _ADJECTIVE), ("nowa", "nowy:A", "adj:sg:nom.voc:f:pos"), ("nowego", "nowy:A", "adj:sg:gen:m1.m2.m3.n:pos"), ("nowemu", "nowy:A", "adj:sg:dat:m1.m2.m3.n:pos"),
    ("czerwony", "czerwony:A", _ADJECTIVE), ("czerwonego", "czerwony:A", "adj:sg:gen:m1.m2.m3.n:pos"), ("czerwona", "czerwony:A", "adj:sg:nom.voc:f:pos"),
    ("polska", "polski", "adj:sg:nom.voc:f:pos"), ("polską", "polski", "adj:sg:inst:f:pos adj:sg:acc:f:pos"),
    ("okno", "okno", "subst:sg:nom.acc.voc:n:ncol"), ("książka", "książka", "subst:sg:nom:f"), ("samochód", "samochód", "subst:sg:nom.acc:m3"), ("samochodu", "samochód", "subst:sg:gen:m3"), ("klucz", "klucz", "subst:sg:nom.acc:m3"), ("klucza", "klucz", "subst:sg:gen:m3"),
    ("kawę", "kawa", "subst:sg:acc:f"), ("kawy", "kawa", "subst:sg:gen:f"), ("kawa", "kawa", "subst:sg:nom:f"), ("budynek", "budynek", "subst:sg:nom.acc:m3"), ("budynkowi", "budynek", "subst:sg:dat:m3"), ("pomoc", "pomoc", "subst:sg:nom:f subst:sg:acc:f"), ("pomocy", "pomoc", "subst:sg:gen:f"),
    ("radio", "radio", "subst:sg:nom.acc.voc:n:ncol"), ("radia", "radio", "subst:sg:gen:n:ncol"), ("telefon", "telefon", "subst:sg:nom.acc:m3"), ("telefonu", "telefon", "subst:sg:gen:m3"), ("historia", "historia", "subst:sg:nom:f"), ("historią", "historia", "subst:sg:inst:f"),
    ("nauczyciel", "nauczyciel", "subst:sg:nom:m1"), ("nauczycielem", "nauczyciel", "subst:sg:inst:m1"), ("sklep", "sklep", "subst:sg:nom.acc:m3"), ("sklepu", "sklep", "subst:sg:gen:m3"), ("lekarz", "lekarz", "subst:sg:nom:m1"), ("lekarzowi", "lekarz", "subst:sg:dat:m1"),
    ("przyglądam", "przyglądać", _FIRST), ("potrzebuję", "potrzebować", _FIRST), ("Potrzebuję", "potrzebować", _FIRST), ("szukam", "szukać", _FIRST), ("Szukam", "szukać", _FIRST), ("słucham", "słuchać", _FIRST), ("używam", "używać", _FIRST), ("Używam", "używać", _FIRST),
    ("interesuję", "interesować", _FIRST), ("Interesuję", "interesować", _FIRST), ("jestem", "być", _FIRST), ("ufam", "ufać", _FIRST), ("Ufam", "ufać", _FIRST), ("lubię", "lubić", _FIRST), ("do", "do:P", "prep:gen"), ("Do", "do:P", "prep:gen"),
    ("czyta", "czytać", "fin:sg:ter:imperf"), ("czytają", "czytać", "fin:pl:ter:imperf"), ("czytamy", "czytać", "fin:pl:pri:imperf"), ("czytam", "czytać", _FIRST), ("mieszka", "mieszkać", "fin:sg:ter:imperf"), ("mieszkają", "mieszkać", "fin:pl:ter:imperf"), ("mieszkam", "mieszkać", _FIRST),
    ("Oni", "on:S", "ppron3:pl:nom:m1:ter:akc.nakc:praep.npraep"), ("Ja", "ja", "ppron12:sg:nom:m1.m2.m3.f.n:pri"), ("Ona", "on:S", "ppron3:sg:nom:f:ter:akc.nakc:praep.npraep"), ("My", "my", "ppron12:pl:nom:m1.m2.m3.f.n:pri ppron12:pl:voc:m1.m2.m3.f.n:pri"),
]
#: Sentences with what the detectors find in them by that lexicon: source, start, end, suggestion.
SENTENCES = [
    ("Te duże okno jest otwarte.", [("agreement.nominal_group_te_duze_okno", 0, 2, "To")]),
    ("Ta nowy książka.", [("agreement.nominal_group_ta_nowy_ksiazka", 3, 7, "nowa")]),
    ("Oto, czerwony książka.", [("agreement.nominal_group_ta_nowy_ksiazka", 5, 13, "czerwona")]),
    ("Oni czyta książkę.", [("agreement.subject_verb_oni_czyta", 4, 9, "czytają")]),
    ("My czyta książkę.", [("agreement.subject_verb_my_czyta", 3, 8, "czytamy")]),
    ("Oni mieszka w Warszawie.", [("agreement.subject_verb_present", 4, 11, "mieszkają")]),
    ("Ja, nie mieszka tam.", [("agreement.subject_verb_present", 8, 15, "mieszkam")]),
    ("Nie widzę czerwony samochód.", [("inflection.negated_widziec_nominal_group", 10, 27, "czerwonego samochodu")]),
    ("Nie lubię kawę.", [("inflection.negated_lubic_kawe", 10, 14, "kawy")]),
    ("Przyglądam się nowy budynek.", [("inflection.przygladac_sie_nowy_budynek", 15, 27, "nowemu budynkowi")]),
    ("Potrzebuję pomoc.", [("inflection.government_potrzebowac_pomoc", 11, 16, "pomocy")]),
    ("Szukam samochód.", [("inflection.government_szukac_klucz", 7, 15, "samochodu")]),
    ("Słucham radio.", [("inflection.government_sluchac_radio", 8, 13, "radia")]),
    ("Używam nowy telefon.", [("inflection.government_uzywac_telefon", 7, 19, "nowego telefonu")]),
    ("Używam nowego telefon.", [("inflection.government_uzywac_telefon", 14, 21, "telefonu")]),
    ("Interesuję się polska historia.", [("inflection.government_interesowac_sie_historia", 15, 30, "polską historią")]),
    ("Jestem nauczyciel.", [("inflection.government_byc_nauczyciel", 7, 17, "nauczycielem")]),
    ("Idę do duży sklep.", [("inflection.government_do_sklep", 7, 17, "dużego sklepu")]),
    ("Ufam nowy lekarz.", [("inflection.government_ufac_lekarz", 5, 16, "nowemu lekarzowi")]),
    ("Oni czytają książkę.", []), ("Szukam „samochód”.", []), ("Szukam samochód i klucz.", []), ("Ta nowa książka.", []), ("Oni i ona mieszka tam.", []), ("Ufam Lekarz.", []), ("Szukam nieznane słowo.", []), ("Ona mieszka tam.", []),
]


def lexicon_rows(version: str = LEXICON_VERSION) -> list[tuple]:
    return [(form, lemma, tag, ["nazwa_pospolita"] if tag.startswith("subst") else [], version) for form, lemma, tags in FORMS for tag in tags.split()]
