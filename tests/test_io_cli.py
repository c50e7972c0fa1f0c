"""Readers, sinks, strict results, options, the command line, and hygiene of data sets."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkorekta import cli, config, errors
from sparkorekta.operators import detect, hygiene, score
from sparkorekta.sources import io

TEXT = "Zeby jutro,powiem o tym."


def test_strict_results(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Dobrze."), (3, None)], "doc_id long, text string")
    coded = {r.doc_id: r.json for r in io.to_result_json(detect.analyze(docs, minimum_confidence=0.5), ["spelling", "agreement"], 0.5).collect()}
    body = json.loads(coded[1])
    assert coded[1] == json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")) and body["options"] == {"categories": ["agreement", "spelling"], "minimum_confidence": 0.5}
    first = body["issues"][0]
    broken = {
        "extra": body | {"x": 1},
        "missing": {k: v for k, v in body.items() if k != "options"},
        "version": body | {"schema_version": 2},
        "true": body | {"schema_version": True},
        "nested": body | {"issues": [first | {"y": 1}]},
        "category": body | {"issues": [first | {"category": "other"}]},
        "span": body | {"issues": [first | {"start": 1}]},
        "id": body | {"issues": [first | {"id": "finding_" + "0" * 32}]},
        "twice": body | {"issues": [first, first]},
        "blank": body | {"issues": [first | {"message": " "}]},
        "source": body | {"issues": [first | {"source": "rule:Ż"}]},
        "sure": body | {"issues": [first | {"confidence": 1.5}]},
    }
    raw = [(k, json.dumps(v, ensure_ascii=False)) for k, v in broken.items()] + [("key", coded[1].replace('"text":', '"text":"","text":')), ("nan", coded[1].replace("0.98", "NaN")), ("no", "no json"), ("null", None)]
    rows = spark.createDataFrame([*raw, *((f"good{k}", v) for k, v in coded.items())], "name string, json string")
    got = {r.name: r for r in io.from_result_json(rows).collect()}
    assert all(got[n].valid == n.startswith("good") and (got[n].error is None) == got[n].valid for n in got)
    assert got["good1"].r.text == TEXT and len(got["good1"].r.issues) == 2 and got["good3"].r.text == ""


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Zażółć\ngęś", encoding="utf-8")
    assert io.read_texts(spark, str(tmp_path / "a.txt")).first().text == "Zażółć\ngęś"
    cases = [{"id": "1", "kind": "error", "text": TEXT, "expected_findings": [{"category": "spelling", "start": 0, "end": 4, "original": "Zeby", "suggestion": "Żeby", "rationale": "r"}], "shape_strata": ["short"]}, {"id": "2", "kind": "correct", "text": "Ala", "expected_findings": [{"category": "x", "start": 0, "end": 3, "original": "Ola", "suggestion": "Ela", "rationale": ""}]}, {"id": "2", "kind": "correct", "text": "a", "expected_findings": []}]
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 4, "id": "set", "cases": cases}), encoding="utf-8")
    own = io.read_cases(spark, str(tmp_path / "c.json"), io.QUALITY_CASE)
    assert own.count() == 3 and own.where("id = '1'").first().expected_findings[0].suggestion == "Żeby"
    assert {(r.id, r.fault) for r in io.invalid_cases(own).collect()} == {("2", "span and text differ"), ("2", "id occurs twice")}
    (tmp_path / "c.xml").write_text('<corpus><case id="1" verification="v" tags="a b"><input>Zeby</input><expected_output>Żeby</expected_output><expected_findings><finding category="spelling" start="0" end="4" original="Zeby" suggestion="Żeby"/></expected_findings></case></corpus>', encoding="utf-8")
    row = io.read_cases_xml(spark, str(tmp_path / "c.xml")).first()
    assert (row.id, row.input, row.expected_findings[0].end) == ("1", "Zeby", 4)
    (tmp_path / "f.csv").write_text("word,count,deleted\n Dom ,5,0\nx,9,0\nkot,0,\nzły,3,1\na1,2,0\n", encoding="utf-8")
    words = io.frequency_list(spark, str(tmp_path / "f.csv"))
    assert sorted(map(tuple, words.collect())) == [("dom", 5), ("kot", 1)]
    io.write_frequency_list(words, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["dom 5", "kot 1"]
    (tmp_path / "g.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError):
        io.frequency_list(spark, str(tmp_path / "g.csv"))
    report = spark.createDataFrame([(2, "b"), (1, None)], "n int, x string")
    assert io.write_report(report, str(tmp_path / "r1")) == io.write_report(report.orderBy("n"), str(tmp_path / "r2"))


def test_options_and_command_line(spark, tmp_path, capsys):
    good = tmp_path / "a.toml"
    good.write_text('[analysis]\ncategories = ["spelling"]\nminimum_confidence = 0.5\n')
    assert config.from_toml(good) == config.Options(("spelling",), 0.5) and config.from_config(good).arguments() == {"categories": ["spelling"], "minimum_confidence": 0.5}
    for body in ("[llm]\n", "analysis = 1\n", '[analysis]\ncategories = "spelling"\n', '[analysis]\ncategories = ["x"]\n', "[analysis]\nminimum_confidence = 2\n", "[analysis]\nminimum_confidence = true\n", "?"):
        bad = tmp_path / "b.toml"
        bad.write_text(body)
        with pytest.raises(errors.ConfigurationError):
            config.from_toml(bad)
    with pytest.raises(errors.ConfigurationError) as e:
        config.from_toml(tmp_path / "none.toml")
    assert e.value.code == "configuration.file_not_found"
    out = lambda *a: (cli.run(["analyze", *a], spark), capsys.readouterr().out.rstrip("\n"))
    code, text = out(TEXT)
    lines = text.split("\n")
    assert code == 0 and len(lines) == 2 and lines[0].split("\t")[1:3] == ["spelling", "suggestion"] and lines[0].endswith("rule:spelling.zeby\t0.98")
    assert out("Dobrze.") == (0, "No findings.")
    assert len(json.loads(out(TEXT, "--json", "--category", "punctuation")[1])["issues"]) == 1
    assert out(TEXT, "--config", str(good))[1].count("\n") == 0
    ids = [x.split("\t")[0] for x in lines]
    assert out(TEXT, "--apply", ids[0], "--apply", ids[1]) == (0, "Żeby jutro, powiem o tym.")
    assert json.loads(out(TEXT, "--json", "--apply", ids[0])[1])["corrected_text"] == "Żeby jutro,powiem o tym."
    assert out(TEXT, "--apply", "finding_x")[0] == 1 and out()[0] == 2 and out("x", "--category", "other")[0] == 2 and out("x", "--file", str(tmp_path / "none"))[0] == 2


def test_names_and_templates(spark):
    text = "Jan Kowalski i anna Nowak poszli do Zoo. Potem Ewa-Maria wróciła. Spotkał Jana 12 razy w 3,5 dnia https://a.b/c?d"
    find = hygiene.entities(["anna nowak", "Nowak"])
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").withColumn("s", find("text"))
    row = {r.doc_id: r for r in df.select("*", hygiene.entity_template(F.col("text"), F.col("s")).alias("t"), hygiene.signature(F.col("s")).alias("g")).collect()}
    assert [x.surface for x in row[1].s] == ["Jan Kowalski", "anna Nowak", "Zoo", "Potem Ewa-Maria", "Spotkał Jana"] and row[2].s is None and row[3].s == []
    assert row[1].t.startswith("<entity> i <entity> poszli do <entity>. <entity>") and "<number> razy w <number> dnia <url>" in row[1].t
    assert row[1].g.count("jan") == 2
    marks = spark.createDataFrame([("2024-02-29", True), ("2023-02-29", False), ("2024-2-9", False), (None, False)], "d string, ok boolean")
    assert all(r.got == r.ok for r in marks.select("ok", hygiene.is_date(F.col("d")).alias("got")).collect())
    assert spark.createDataFrame([("é",)], "t string").select(hygiene.composed("t").alias("t")).first().t == "é"


def test_near_templates_equal_all_pairs(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    rows = []
    for k in range(60):
        base = [r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 5, 8, 9, 15, 30]))]
        rows.append(base)
        for _ in range(2):
            other = list(base)
            for _ in range(r.randrange(3)):
                at = r.randrange(len(other) + 1)
                other[at : at + r.randrange(2)] = [r.choice(words)] * r.randrange(2)
            rows.append(other)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], "id long, template string")

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, line = line, [i]
            for j, y in enumerate(b, 1):
                line.append(min(line[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return line[-1]

    want = {}
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            # Which of the two comes first can change the ratio; either counts.
            near = max(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in ((a, b), (b, a)))
            if near >= 0.92 or (max(len(a), len(b)) <= 8 and edits(a, b) <= 1):
                want[j, i] = edits(a, b)
    got = {(x.a, x.b): x.distance for x in hygiene.near_templates(df).collect()}
    assert not set(got) - set(want) and len(set(want) - set(got)) <= len(want) // 100
    assert all(want[k] == d for k, d in got.items()) and len(got) > 60


def test_overlap_providers_and_ranking(spark):
    left = spark.createDataFrame([(1, "Ala ma kota i psa oraz rybki w domu nad rzeką."), (2, "Zupełnie inny tekst o pogodzie."), (3, None)], "doc_id long, text string")
    right = spark.createDataFrame([(1, "ala ma kota i  psa oraz rybki w domu nad rzeką."), (2, "Ala ma kota i psa oraz rybki w domu nad rzeką!"), (3, "Nic.")], "doc_id long, text string")
    assert tuple(hygiene.keyed_overlap(left, right, b"k" * 32).first()) == (1, 1)
    with pytest.raises(ValueError):
        hygiene.keyed_grams(b"short")
    cases = spark.createDataFrame([(True, True, ["dom"], ["dom"]), (True, False, [], ["kot"]), (True, True, ["a", "pies"], ["pies"]), (False, True, [], []), (False, False, [], [])], "wrong boolean, flagged boolean, candidates array<string>, expected array<string>")
    assert [round(x, 3) for x in score.provider_metrics(cases).first()] == [0.667, 0.667, 0.333, 0.5]
    forms = spark.createDataFrame([("a", "a"), ("b", "c"), ("d", None), (None, "e")], "expected string, made string")
    assert tuple(score.form_metrics(forms).first()) == (1, 2, 2, 1 / 3, 1 / 3)
    runs = spark.createDataFrame([("p", 100, 0.5), ("p", 300, 1.5)], "profile string, code_points long, seconds double")
    assert tuple(score.throughput(runs, ["profile"]).first()) == ("p", 2, 400, 1.0, 200.0)
    families = spark.createDataFrame([("b", "s", 0, 1, 5), ("a", "s", 0, 1, 5), ("c", "s", 0, 0, 9)], "id string, scope string, provider int, risk int, evidence int")
    assert [r.id for r in score.ranking(families).orderBy("rank").collect()] == ["c", "a", "b"]
