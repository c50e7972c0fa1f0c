"""Detectors, guards, selection and application on one sentence each."""

import random
import re

from pyspark.sql import functions as F

from sparkorekta.functions.text import spans
from sparkorekta.operators import catalog, detect, score, segment

GOLDEN = [
    ("agreement.copula", "Ty jest zmęczony.", "Ty jesteś zmęczony."),
    ("agreement.copula_ja", "Ja jest tutaj.", "Ja jestem tutaj."),
    ("agreement.te_zdanie", "Te zdanie kończy tekst.", "To zdanie kończy tekst."),
    ("agreement.te_neuter_noun", "Te morze szumi.", "To morze szumi."),
    ("inflection.negated_miec_czas", "Nie mam czas.", "Nie mam czasu."),
    ("inflection.numeral_five_genitive_plural", "Pięć książki stoi tam.", "Pięć książek stoi tam."),
    ("spelling.wogole", "Wogole nie wiem.", "W ogóle nie wiem."),
    ("spelling.zeby", "ZEBY nie padało.", "ŻEBY nie padało."),
    ("spelling.month_weekday_lowercase", "Wrócę we Wtorek rano.", "Wrócę we wtorek rano."),
    ("spelling.sentence_initial_capital", "Skończyłem. teraz odpocznę.", "Skończyłem. Teraz odpocznę."),
    ("syntax.comma_space", "Tak,jasne.", "Tak, jasne."),
    ("syntax.duplicate_comma", "Tak,, jasne.", "Tak, jasne."),
    ("syntax.comma_before_ze_reporting", "Myślę że zdążę.", "Myślę, że zdążę."),
    ("syntax.comma_before_zeby_purpose", "Proszę żeby wrócił.", "Proszę, żeby wrócił."),
    ("syntax.comma_before_bo", "Śpię bo mogę.", "Śpię, bo mogę."),
    ("syntax.missing_reflexive", "Ona boi psa.", "Ona boi się psa."),
    ("syntax.list_space", "-raz\n-dwa", "- raz\n- dwa"),
    ("syntax.sentence_space", "Koniec.Nowe.", "Koniec. Nowe."),
    ("punctuation.abbreviation_dot", "Noże itp rzeczy.", "Noże itp. rzeczy."),
]
GOLDEN += [
    ("spelling.arcy_prefix", "To jest arcy Europa.", "To jest arcy-Europa."),
    ("spelling.co_niemiara", "Mamy problemów coniemiara.", "Mamy problemów co niemiara."),
    ("spelling.month_weekday_lowercase", "Spotkamy się w Poniedziałek.", "Spotkamy się w poniedziałek."),
    ("spelling.proper_adjective_lowercase", "Uczę się języka Polskiego.", "Uczę się języka polskiego."),
    ("spelling.sentence_initial_capital", "To działa. potem wróciłem.", "To działa. Potem wróciłem."),
    ("syntax.comma_before_bo", "ZOSTAJĘ BO PADA.", "ZOSTAJĘ, BO PADA."),
    ("syntax.comma_before_bo", "Uwaga: ZOSTAJĘ BO PADA.", "Uwaga: ZOSTAJĘ, BO PADA."),
    ("syntax.initial_conditional_comma", "Jeśli pada zostaję w domu.", "Jeśli pada, zostaję w domu."),
    ("syntax.initial_temporal_comma", "Gdy pada zostaję w domu.", "Gdy pada, zostaję w domu."),
    ("syntax.missing_correlative", "Im więcej ćwiczę, bardziej rozumiem.", "Im więcej ćwiczę, tym bardziej rozumiem."),
    ("syntax.missing_destination_preposition", "Pojechałem Warszawy.", "Pojechałem do Warszawy."),
    ("syntax.quote_space", 'On powiedział"zatem."', 'On powiedział" zatem."'),
    ("inflection.negated_widziec", "Uwaga: Nie widzę samochód i znów nie widzę samochód.", "Uwaga: Nie widzę samochodu i znów nie widzę samochodu."),
    ("punctuation.abbreviation_dot", "Noże itp  rzeczy.", "Noże itp.  rzeczy."),
]
CLEAN = ["Pisz na zeby@a.pl.", "Strona www.zeby.pl działa.", "Słowo „zeby” jest złe.", "zmienna zeby_x = 1", "My jesteśmy gotowi.", "Mam 1,5 kg i 2.Xa", "No bo tak.", "Cena np,a", "", None]
CLEAN += [
    "Ona boi się.", "Ona boi się, lecz idzie.", "On boi ", "Muzeum Historii Polski", "Instytut Języka Polskiego", "język POLSKI", "W Poniedziałek odpoczywam", "w PONIEDZIAŁEK", "Był w Poniedziałek Wielkanocny", "Skończyłem.  teraz odpocznę",
    "Skończyłem.\nteraz odpocznę", "Wywołaj `zeby()` teraz", "Nie mam czas i sił.", "Nie widzę samochód, nie widzę samochód.", "Nie mam czas", "Rzecz arcy, Europa", "arcy Europa", "(arcy Europa)", "Marka coniemiara", "To Coniemiara", "a = coniemiara", "To tylko bo tak.", "ZOSTAJĘ BO PADA I już",
]


def test_each_detector_and_clean_texts(spark):
    rows = [(k, s, t, w) for k, (s, t, w) in enumerate(GOLDEN)] + [(100 + k, "", t, t) for k, t in enumerate(CLEAN)]
    own = detect.analyze(spark.createDataFrame(rows, "doc_id long, source string, text string, want string"))
    own = own.withColumn("hit", F.filter("issues", lambda f: f.source == F.col("source"))).withColumn("got", detect.apply(F.coalesce("text", F.lit("")), F.col("hit")))
    wrong = []
    for r in own.collect():
        if r.source and r.got != r.want or not r.source and r.issues:
            wrong.append((r.source, r.text, r.got, [(f.source, f.start) for f in r.issues]))
        for f in r.issues:
            assert r.text[f.start : f.end] == f.original and f.suggestion != f.original and f.message and f.explanation
            assert catalog.SOURCES[f.rule_ord] == f.source
    assert not wrong


def test_linear_selection_equals_the_pairwise_rule(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(150):
        spans_ = sorted({(a, a + rnd.randrange(4)) for a in (rnd.randrange(20) for _ in range(rnd.randrange(90)))})
        rows.append((k, [(a, b, "x" * (b - a), "y", "syntax", "suggestion", "m", "e", 0.9, "s", 0) for a, b in spans_]))
    df = spark.createDataFrame(rows, f"doc_id int, issues array<{detect.FINDING}>")
    for r in df.select("issues", detect.select(F.col("issues")).alias("chosen")).collect():
        want = []
        for x in r.issues:
            def clash(y):
                if x.start == x.end and y.start == y.end:
                    return x.start == y.start
                if x.start == x.end or y.start == y.end:
                    i, s = (x, y) if x.start == x.end else (y, x)
                    return s.start <= i.start <= s.end
                return x.start < y.end and y.start < x.end
            if not any(map(clash, want)):
                want.append(x)
        assert r.chosen == want


def test_explicit_application_and_its_errors(spark):
    text = "Zeby jutro,powiem,tak."
    base = detect.analyze(spark.createDataFrame([(1, text, "clash")], "doc_id long, text string, issues string"))
    ids = [x["__ids"] for x in detect.with_issue_ids(base).collect()][0]
    cases = [([], None, text), (ids[:1], None, "Żeby jutro,powiem,tak."), (ids[::-1], None, "Żeby jutro, powiem, tak."), ([ids[0], ids[0]], detect.UNKNOWN, None), (["no"], detect.UNKNOWN, None), ([""], detect.UNKNOWN, None), (None, detect.UNKNOWN, None)]
    picks = spark.createDataFrame([(k, c) for k, (c, _, _) in enumerate(cases)], "n int, chosen array<string>")
    got = {r.n: (r.error_code, r.corrected) for r in detect.apply_selected(picks.crossJoin(base)).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases]
    two = base.withColumn("issues", F.concat("issues", F.transform(F.slice("issues", 1, 1), lambda f: f.withField("suggestion", F.lit("Aby")))))
    both = [x["__ids"] for x in detect.with_issue_ids(two).collect()][0]
    assert detect.apply_selected(two.withColumn("chosen", F.array(F.lit(both[0]), F.lit(both[-1])))).first().error_code == detect.CONFLICT
    none = base.withColumn("issues", F.transform("issues", lambda f: f.withField("suggestion", F.lit(None).cast("string"))))
    own = [x["__ids"] for x in detect.with_issue_ids(none).collect()][0]
    assert detect.apply_selected(none.withColumn("chosen", F.array(F.lit(own[0])))).first().error_code == detect.UNCORRECTABLE


def test_policy_and_normalisation(spark):
    found = detect.with_ids(detect.findings(spark.createDataFrame([(1, "Zeby jutro,powiem Napewno itp rzeczy.")], "doc_id long, text string")))
    names = ["ord", "source", "category", "operation", "behavior_version", "severity", "confidence", "needs_morphology"]
    table = spark.createDataFrame(catalog.entries(), names)
    rows = spark.createDataFrame(catalog.policy(), ["source", "category", "operation", "behavior_version", "policy_version", "minimum_confidence"])
    assert len(catalog.entries()) == 63 and rows.count() == 8
    held = {r.source for r in detect.join_policy(found, table, rows).collect()}
    assert held == {"spelling.zeby", "syntax.comma_space"}
    assert {r.source for r in found.where(detect.eligible(F.struct("source", "category", "confidence"))).collect()} == held
    for column in ("category", "operation", "behavior_version", "policy_version"):
        assert detect.join_policy(found, table, rows.withColumn(column, F.concat(column, F.lit("x")))).count() == 0
    assert detect.join_policy(found.withColumn("confidence", F.lit(0.89)), table, rows).count() == 0
    twice = found.unionByName(found.withColumn("confidence", F.lit(0.1)))
    own = detect.normalize_findings(twice, ["spelling"], 0.05).orderBy("rank").collect()
    assert [(r.source, r.confidence, r["rank"]) for r in own] == [("spelling.zeby", 0.98, 1), ("spelling.napewno", 0.98, 2)]


def test_compat_keeps_the_unbounded_copula(spark):
    df = spark.createDataFrame([(1, "My jesteśmy tu.")], "doc_id long, text string")
    assert detect.findings(df, sources=["agreement.copula"], compat=True).count() == 1


def test_correct_and_ids(spark):
    df = spark.createDataFrame([(1, "Zeby jutro,powiem o tym.")], "doc_id long, text string")
    assert detect.correct(df).first().corrected == "Żeby jutro, powiem o tym."
    ids = [r.id for r in detect.with_ids(detect.findings(df)).collect()]
    assert len(set(ids)) == 2 and all(re.fullmatch("finding_[0-9a-f]{32}", i) for i in ids)


def test_spans_equal_finditer(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab,. \r\nżé😀𝒳́") for _ in range(rnd.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", spans("text", "[,.]+b?", size=4).alias("s"))
    for r in df.collect():
        assert [(x.start, x.end) for x in r.s] == [m.span() for m in re.finditer("[,.]+b?", texts[r.doc_id])]


def test_segments_concatenate(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", " ", ".", "!", "np.", "itd...", "\ue001", "\n", "\r\n", "”", "1.5", "Ż"]) for _ in range(rnd.randrange(30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for of in (segment.paragraphs_of, segment.sentences_of):
        for r in df.select("text", of(F.col("text")).alias("p")).collect():
            assert "".join(p.text for p in r.p) == r.text
            assert all(r.text[p.start : p.end] == p.text for p in r.p)


def test_abbreviations_end_no_sentence(spark):
    rows = [("Noże itd... Potem m.in. tak. Koniec!", ["Noże itd... Potem m.in. tak.", " Koniec!"]), ("Ma 1.5 kg. Nie xnp. Tak", ["Ma 1.5 kg.", " Nie xnp.", " Tak"]), ("NP. tak.", ["NP. tak."])]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [p.text for p in r.p] for r in df.select("doc_id", segment.sentences_of(F.col("text")).alias("p")).collect()}
    assert [got[k] for k in range(len(rows))] == [w for _, w in rows]


def test_scores_and_personal_data(spark):
    kinds = "doc_id long, start int, end int, category string, original string, suggestion string"
    cases = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    want = spark.createDataFrame([(1, 0, 1, "p", ",", ", "), (1, 5, 6, "p", ",", ", ")], kinds)
    got = spark.createDataFrame([(1, 0, 1, "p", ",", ", "), (2, 0, 1, "p", ",", ", ")], kinds)
    total = {r.category: r for r in score.ratios(score.counts(cases, got, want)).collect()}[None]
    assert (total.true_positives, total.false_positives, total.false_negatives, total.false_alarm_cases, total.correct_cases, total.precision) == (1, 1, 1, 1, 2, 0.5)
    docs = spark.createDataFrame([(1, "a@b.pl 44051401359 oraz 526-104-08-28, https://x.y"), (2, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in score.pii(docs).collect()}
    assert (r[1].emails, r[1].urls, r[1].pesel, r[1].nip) == (1, 1, 1, 1) and r[2].emails == 0


def test_stream_equals_batch(spark, tmp_path):
    from sparkorekta.streaming.stream import correct_stream

    df = spark.createDataFrame([(1, "Tak,jasne."), (2, "Dobrze.")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    query = correct_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("corrected").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("corrected").collect())) == sorted(map(tuple, correct_stream(df).collect()))


def test_source_scores_and_token_distance(spark):
    from pyspark.sql import functions as F

    kinds = "doc_id long, source string, start int, end int, category string, original string, suggestion string"
    cases = spark.createDataFrame([(1, "error", "s"), (2, "correct", "s"), (3, "error", "t")], "doc_id long, role string, source string")
    want = spark.createDataFrame([(1, "s", 0, 1, "p", ",", ", "), (1, "s", 5, 6, "p", ",", ", ")], kinds)
    got = spark.createDataFrame([(1, "s", 0, 1, "p", ",", ", "), (1, "s", 5, 6, "p", ",", " ,"), (2, "s", 0, 1, "p", ",", ", ")], kinds)
    rated = score.source_ratios(score.source_counts(cases, got, want))
    r = {x.source: x for x in rated.collect()}
    assert [r["s"][c] for c in score.SOURCE_COUNTS] == [1, 1, 1, 2, 1, 2, 1, 1] and r["s"].false_alarm_rate == 1.0
    assert r["t"].precision is None and r["t"].error_cases == 1
    policy = spark.createDataFrame([("s", 0.9, False), ("t", 0.9, False)], "source string, emitted_confidence double, insufficient boolean")
    sure = got.withColumn("confidence", F.lit(0.9))
    of = lambda floor: {x.source: x.verdict for x in score.verdicts(rated, sure, policy, {"recall": floor}, 1.0, 1, 1).collect()}
    assert of(0.5) == {"s": "candidate", "t": "insufficient_evidence"} and of(0.6)["s"] == "fail_threshold"
    rows = [("a b c", "a c", 1), ("<num> kotów, tak", "<num> psów, tak", 1), ("", "x y", 2), ("a b", "b a", 2), (None, "x", None)]
    df = spark.createDataFrame(rows, "a string, b string, d int")
    own = df.select("d", score.token_distance(score.template_tokens(F.col("a")), score.template_tokens(F.col("b"))).alias("got"))
    assert all(x.got == x.d for x in own.collect())


def _judged_tables(spark):
    """Cases, predictions and expectations with repeats, null ids, ids that are no case, and matches of spans alone."""
    rnd = random.Random(3)
    kinds = "doc_id long, start int, end int, category string, original string, suggestion string"
    one = lambda: (rnd.choice([None, *range(8)]), rnd.randrange(2), 2, rnd.choice(["syntax", "style", "other"]), "a", rnd.choice([None, "x", "y"]))
    cases = [(rnd.choice([None, *range(6)]), rnd.choice(["correct", "incorrect"])) for _ in range(20)]
    got, want = [(*one(), rnd.choice(["rule", "llm", None])) for _ in range(60)], [one() for _ in range(40)]
    return (cases, got, want), (spark.createDataFrame(cases, "doc_id long, outcome string"), spark.createDataFrame(got, kinds + ", kind string"), spark.createDataFrame(want, kinds))


def _met(got, want, keys):
    from collections import Counter

    return sum((Counter(x[:keys] for x in got) & Counter(x[:keys] for x in want)).values())


def test_counts_read_their_texts_once_and_equal_a_plain_version(spark):
    from sparkorekta.plans import queries

    plan = queries.score_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # texts for the findings, ids of the cases
    (cases, got, want), tables = _judged_tables(spark)
    clean = [d for d, _ in cases if d not in {x[0] for x in want if x[0] is not None}]
    out = {r.category: r for r in score.counts(*tables).collect()}
    assert set(out) == {None, *(x[3] for x in got + want)}
    for name, r in out.items():
        p, e = ([x for x in xs if name in (None, x[3])] for xs in (got, want))
        t = _met(p, e, 6)
        assert tuple(r)[1:] == (len(cases), len(clean), t, len(p) - t, len(e) - t, _met(p, e, 4), len({x[0] for x in p} & set(clean) - {None}))
    empty = [t.limit(0) for t in tables]
    assert [tuple(r) for r in score.counts(*empty).collect()] == [(None, 0, 0, 0, 0, 0, 0, 0)]


def test_grouped_counts_read_their_texts_once_and_equal_a_plain_version(spark):
    from sparkorekta.plans import queries

    plan = queries.score_grouping_sets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # texts for the findings, ids of the cases
    (cases, got, want), tables = _judged_tables(spark)
    clean = [d for d, outcome in cases if outcome == "correct"]
    out = {(r.grouping, r.name): r for r in score.grouped_counts(*tables).collect()}
    assert len(out) == 9
    for (grouping, name), r in out.items():
        p = [x for x in got if grouping == "all" or name == x[3 if grouping == "category" else 6]]
        e = [x for x in want if grouping != "category" or name == x[3]]
        t = _met(p, e, 6)
        assert tuple(r)[2:] == (len(e), len(p), t, len(p) - t, len(e) - t, _met(p, e, 4), len(clean), len({x[0] for x in p} & set(clean) - {None}))
    assert {tuple(r)[2:] for r in score.grouped_counts(*[t.limit(0) for t in tables]).collect()} == {(0,) * 8}
