"""The detectors with morphology on sentences, with the small lexicon, with another version and with none."""

from sparkorekta.operators import catalog, morphology
from sparkorekta.plans.lexicon import SENTENCES, lexicon_rows


def test_morphology_detectors(spark):
    docs = spark.createDataFrame([*((k, t, "clash") for k, (t, _) in enumerate(SENTENCES)), (900, None, ""), (901, "", "")], "doc_id long, text string, source string")
    table = spark.createDataFrame(lexicon_rows(), morphology.LEXICON)
    rows = morphology.findings(docs, table).collect()
    got = {(r.doc_id, r.source, r.start, r.end, r.suggestion) for r in rows}
    want = {(k, *f) for k, (_, found) in enumerate(SENTENCES) for f in found}
    assert sorted(got - want) == [] and sorted(want - got) == []
    assert {r.source for r in rows} == set(catalog.MORPHOLOGY)
    assert all(SENTENCES[r.doc_id][0][r.start : r.end] == r.original and r.confidence == 0.9 for r in rows)
    assert morphology.findings(docs, spark.createDataFrame(lexicon_rows("another"), morphology.LEXICON)).count() == 0
    assert morphology.findings(docs, table.limit(0)).count() == 0
    both = morphology.all_findings(docs, table, categories=["inflection"])
    assert {r.category for r in both.select("category").distinct().collect()} == {"inflection"}
    # A second form for the target, or a second reading of a word, makes the answer unsure.
    more = table.unionByName(spark.createDataFrame([("telefona", "telefon", "subst:sg:gen:m3", ["nazwa_pospolita"], catalog.LEXICON_VERSION), ("lekarz", "inny", "subst:sg:nom:m1", ["nazwa_pospolita"], catalog.LEXICON_VERSION)], morphology.LEXICON))
    left = {r.source for r in morphology.findings(docs, more).collect()}
    assert set(catalog.MORPHOLOGY) - left == {"inflection.government_uzywac_telefon", "inflection.government_ufac_lekarz"}
