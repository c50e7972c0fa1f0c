"""Each stage of the corpus pipeline against a plain version, with repeated and null ids, null and empty texts and an empty table."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from sparkorekta.llm import quality, simhash, toxicity
from test_llm import brute_contamination, groups_of

DDL = "doc_id long, text string, lang string, source string, n_chars long"
r = random.Random(12)
VOCABULARY = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ar", "en", "il", "os", "um", "eta", "olo")]


def prose(n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


ITEM = "a train leaves at 10 km from Paris and meets the other train after 20 minutes near Paris on monday evening"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    good = [prose(40) for _ in range(300)]
    texts = [(k, t) for k, t in enumerate(good)]
    texts += [(1000 + k, " ".join(w.upper() + "!!" for w in prose(40).split())) for k in range(120)]  # poor
    texts += [(2000 + k, f"{prose(15)} idiot moron {prose(15)}") for k in range(120)]  # toxic
    texts += [(3000 + k, good[k]) for k in range(20)]  # copies
    texts += [(3100 + k, " ".join([*good[30 + k].split()[:-1], "other"])) for k in range(20)]  # near copies
    texts += [(3200, f"{prose(10)} {ITEM} {prose(10)}"), (3201, f"{prose(10)} {ITEM.replace('10', '35').replace('Paris', 'London')}")]
    again = good[70]
    # One doc_id for two texts, one of them a copy; equal rows; rows without doc_id that are copies of each other.
    texts += [(71, again), (72, good[72]), (None, good[80]), (None, lone := prose(40)), (None, lone), (None, prose(40)), (4000, None), (4001, ""), (4002, None)]
    rows = [(i, t, "en", "s1", len(t or "")) for i, t in texts]
    path = tmp_path_factory.mktemp("sf")
    labels = [(i, int(not 1000 <= i < 2000), int(2000 <= i < 3000)) for i, _ in texts if i is not None and i < 3000 and i % 2]
    spark.createDataFrame(rows, DDL).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows


def rows_of(df):
    return Counter(tuple(x) for x in df.collect())


def test_classifier_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    # Each row is decided by the score of its own text.
    feats = quality.features(docs)
    model = quality.train(spark, docs, labels)
    verdict = Counter((x.doc_id, x.keep) for x in quality.score(spark, docs, model).collect())
    got = cp.quality_filter(spark, docs, path)
    assert got.columns == docs.columns and feats.count() == len(rows)
    kept = rows_of(got)
    assert not kept - Counter(rows) and Counter(i for (i, *_), n in kept.items() for _ in range(n)) == Counter({i: n for (i, k), n in verdict.items() if k})
    assert all(kept[x] >= 1 for x in rows[:300]) and sum(kept[x] for x in rows[300:420]) <= 2
    tox = toxicity.train(spark, docs, labels)
    score = {x.text: x.score for x in toxicity.score(spark, docs, tox).join(docs.select("doc_id", "text"), "doc_id").collect()}
    kept = rows_of(cp.toxicity_filter(spark, docs, path))
    assert sum(kept[x] for x in rows[420:540]) == 0 and all(kept[x] >= 1 for x in rows[:300]) and score
    assert all((kept[x] > 0) == (score[x[1]] < 0.3) for x in rows if x[0] is not None and x[0] < 3000 and x[0] not in (71, 72))


def test_near_duplicate_stage(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (x[1] or "").split()) else set() for x in rows]
    label = groups_of(len(rows), lambda a, b: sets[a] == sets[b] or (bool(sets[a] and sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])))
    kept = rows_of(cp.near_duplicate_filter(spark, docs, path))
    assert sum(kept.values()) == len(set(label))  # one row of each group
    for group in set(label):
        own = [rows[k] for k in range(len(rows)) if label[k] == group]
        ids = [x[0] for x in own if x[0] is not None]
        here = [x for x in own if kept[x]]
        assert here and len({(x[0], x[1]) for x in here}) == 1 and here[0][0] == min(ids, default=None)


def test_decontamination_and_token_stages(spark, folder):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from sparkorekta.llm import decontaminate

    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    form = lambda df: [(x.t, x.f) for x in df.select(decontaminate.marked_tokens(F.col("text")).alias("t")).select("t", decontaminate.template(F.col("t")).alias("f")).collect()]
    item = form(spark.read.parquet(f"{path}/benchmark.parquet"))[0]
    texts = sorted({x[1] or "" for x in rows})
    own = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1).orderBy("n")
    bad = {t for t, f in zip(texts, form(own)) if brute_contamination(*f, *item)}
    assert len(bad) == 2
    assert rows_of(cp.decontamination_filter(spark, docs, path)) == Counter(x for x in rows if (x[1] or "") not in bad)
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for x in rows:
        ids = library.encode(x[1] or "", add_special_tokens=False).ids
        want[x[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert rows_of(cp.tokens(spark, docs, path)) == want


def test_run_and_empty_table(spark, folder, tmp_path):
    path, rows = folder
    out = cp.run(spark, path).collect()
    ids = [x.doc_id for x in out]
    assert set(range(300)) - {70} - set(ids) == set() and not any(i is not None and (1000 <= i < 3000 or i >= 3100 and i < 3300) for i in ids)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
    # Extra columns, also with names that the stages use, pass through.
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 13, "x", 5, True)], DDL + ", row string, key long, keep boolean")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name


def test_crowded_prefixes_are_split_and_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = np.uint64(0xABCDEF0123456789)
    x = {int(base)}
    for _ in range(700):  # a dense cloud around one fingerprint, differing in low and high bits
        v = base
        for b in rng.choice([0, 1, 2, 3, 5, 8, 40, 61, 62, 63], rng.integers(1, 7), replace=False):
            v ^= np.uint64(1) << np.uint64(b)
        x.add(int(v))
    x |= {int(v) for v in rng.integers(0, 1 << 63, 300, dtype=np.uint64)}
    x = sorted(x)
    df = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(x)], "rep long, fp long")
    want = groups_of(len(x), lambda a, b: (x[a] ^ x[b]).bit_count() <= 2)
    edges = [(e.a, e.b) for e in simhash.link(spark, df, 2, group_rows=16).collect()]
    label = list(range(len(x)))
    for _ in range(len(x)):
        before = list(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert label == want
