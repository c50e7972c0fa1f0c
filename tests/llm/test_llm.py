"""The operators against brute force, libraries and edge cases."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkorekta.llm import bpe, common, decontaminate, embeddings, kneser_ney, licenses, quality, simhash, token_count, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, k string, h string"
rnd = random.Random(9)
WORDS = ["alpha", "beta", "gamma", "delta", "Żółw", "it's", "2024", "x" * 30, "!!", "…"]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [prose(rnd.randrange(1, 60)) for _ in range(60)]
    texts += [texts[0], texts[0], "", None, " \n\t", "a", "z" * 20_000, prose(5_000)]
    rows = [(k, t, rnd.choice(["en", None]), "s", "clash", None) for k, t in enumerate(texts)] + [(3, texts[3], "en", "s", "again", None), (None, texts[4], "en", "s", "no id", None)]
    return spark.createDataFrame(rows, DOCS)


def groups_of(n, linked):
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_components(spark):
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(40)]
    label = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in common.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in label.items() if any(a != b and v in (a, b) for a, b in edges)}


def test_gray_tree_finds_all():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    x[200:400] = x[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    x[400:500] = x[:100] ^ np.uint64(0b111)
    q, m = simhash.GrayTree(x).search(x, 2)
    assert sorted(zip(q, m)) == sorted(zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)))


def test_gray_tree_of_signatures_finds_all():
    """Random signatures, near copies of some, a large cluster and exact copies, in groups of any size."""
    rng = np.random.default_rng(4)
    flip = lambda x, n: x ^ np.packbits(np.stack([rng.permutation(np.arange(1024) < n) for _ in x]), axis=1).view(np.uint64)
    base = rng.integers(0, 1 << 63, (400, 16), dtype=np.uint64)
    x = np.concatenate([base, flip(base[:100], 163), flip(base[:100], 164), flip(base[100:140], 90), flip(np.repeat(base[200:201], 300, axis=0), 80), base[300:305]])
    x = x[np.argsort(simhash.gray_rank(x[:, 0]), kind="stable")]
    for size in (1, 2, 16, 17, 300, len(x)):
        apart = np.bitwise_count(x[:, None] ^ x[None, :size]).sum(axis=2, dtype=np.int64)
        found = [(s + q, m) for s in range(0, len(x), 64) for q, m in [simhash.GrayTree(x[:size]).near(x[s : s + 64], 163)]]
        assert sorted((a, b) for q, m in found for a, b in zip(q, m)) == sorted(zip(*np.nonzero(apart <= 163)))


def test_simhash(spark, docs):
    import xxhash

    def fp(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = docs.collect()
    marks = [fp(r.text) for r in rows]
    label = groups_of(len(rows), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2 or (rows[a].doc_id is not None and rows[a].doc_id == rows[b].doc_id))
    want = Counter((rows[k].doc_id, marks[k], min((rows[j].doc_id for j in range(len(rows)) if label[j] == label[k] and rows[j].doc_id is not None), default=None)) for k in range(len(rows)))
    got = Counter((r.doc_id, r.fp & common.M64, r.component_id) for r in simhash.near_duplicates(spark, docs).collect())
    assert got == want
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_similar_groups(spark):
    base = [" ".join(f"w{rnd.randrange(10_000)}" for _ in range(200)) for _ in range(20)]
    near = [b.replace(b.split()[100], "other", 1) for b in base]
    rows = [*enumerate([*base, *near, base[0], "", None])]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == k and got[20 + k] == k for k in range(20)) and got[40] == 0 and len(got) == 43


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[100:180] = x[:80] + rng.normal(size=(80, 16)) * 0.03
    rows = [(k, [float(np.float32(c)) for c in v], k % 3) for k, v in enumerate(x)]
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, rows[0][1], None), (1005, [None] * 16, 1), (1006, [], 1)]
    # Null ids: alone, with one that has an id, as a bridge and equal to another; an id that occurs twice.
    rows += [(None, [9.0] + [0.0] * 15, 0), (None, rows[4][1], 1), (None, rows[4][1], 1), (None, [-5.0] * 16, 2), (None, [-5.0] * 15 + [-5.1], 2), (7, rows[9][1], 0), (7, rows[20][1], 2)]
    turn = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    rows += [(2005, turn(0), 5), (None, turn(10), 5), (2009, turn(20), 5), (None, turn(30), 5), (2001, turn(40), 5)]
    ok = [r[1] is not None and len(r[1]) > 0 and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1]) and r[2] is not None for r in rows]
    cos = lambda a, b: np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))
    linked = lambda a, b: ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cos(np.array(rows[a][1]), np.array(rows[b][1])) >= 0.98
    label = groups_of(len(rows), linked)
    want = Counter()
    for k, r in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None), default=None)
        want[r[0], sum(linked(k, j) for j in range(len(rows)) if j != k), low, r[0] is not None and r[0] == low] += 1
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, component_id string")
    for sizes in ({}, {"shard_rows": 16, "block_rows": 20, "span": 2}):
        assert Counter(tuple(r) for r in embeddings.near_duplicates(spark, df, **sizes).collect()) == want
    assert embeddings.near_duplicates(spark, df.limit(0)).count() == 0


def test_embedding_audit_counts_pairs_of_different_vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    x[300:] = x[:300] + rng.normal(size=(300, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b, known, got = embeddings.neighbours(embeddings.Graph(x), x, x, 0.98, np.arange(600))
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.98)) if i != j}
    assert known >= 100 and got >= 0.995 * known and len(set(zip(a.tolist(), b.tolist())) & want) >= 0.99 * len(want)
    none = embeddings.neighbours(embeddings.Graph(np.eye(8)), np.eye(8), np.eye(8), 0.98, np.arange(8))
    assert len(none[0]) == 0 and none[2:] == (0, 0)


def test_kneser_ney(spark, docs):
    train = docs.where("doc_id < 50")
    for order in (1, 2, 3):
        model = kneser_ney.train(spark, train, order)
        got = kneser_ney.score(docs, model).collect()
        texts = [(r.text or "").encode().lower().split() for r in train.collect()]
        grams = Counter(tuple(s[k - order + 1 : k + 1]) for t in texts for s in [["<"] * (order - 1) + t + [">"]] for k in range(order - 1, len(s)))
        raw = Counter(w for t in texts for w in [*t, ">"])
        levels = {order: grams}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        disc = {k: kneser_ney._discounts(*[sum(c == n for c in g.values()) for n in (1, 2, 3, 4)]) for k, g in levels.items()}

        def prob(g):
            k = len(g)
            if not k:
                return 1 / (len(raw) + 1)
            follow = [c for h, c in levels[k].items() if h[:-1] == g[:-1]]
            if not follow:
                return prob(g[1:])
            d = lambda c: disc[k][min(c, 3) - 1] if c else 0
            c = levels[k][g]
            return (max(c - d(c), 0) + sum(map(d, follow)) * prob(g[1:])) / sum(follow)

        memo = {}
        for r, row in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)), sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))):
            t = (row.text or "").encode().lower().split()
            if len(t) > 100:
                continue
            s = ["<"] * (order - 1) + t + [">"]
            want = sum(math.log10(memo.setdefault(g, None) or memo.update({g: prob(g)}) or memo[g]) for k in range(order - 1, len(s)) for g in [tuple(s[k - order + 1 : k + 1])])
            base = sum(math.log10((raw[w] + 1) / (sum(raw.values()) + len(raw) + 1)) for w in [*t, ">"])
            assert r.n_tokens == len(t) + 1 and r.score == pytest.approx(want) and r.base_score == pytest.approx(base) and r.n_known == sum(raw[w] > 0 for w in [*t, ">"])
        vocabulary = [*raw, "unseen"]
        if order == 2:
            assert sum(prob(("alpha" if b"alpha" not in raw else b"alpha", w)) for w in vocabulary) == pytest.approx(1)
    assert kneser_ney.score(docs, kneser_ney.train(spark, docs.limit(0))).first().score == 0


def test_token_counts_and_bpe_equal_the_libraries(spark, docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    alphabet = "aabetin s▁  \n\t'’żЖ中😀1½!?.<|\xa0\x1c"
    odd = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) for _ in range(300)] + ["<|endoftext|>a <|endoftext|>", "a" * 900, " " * 300 + "x", "<s> </s>", "▁", "ab " * 3000]
    own = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    texts = [(r.doc_id, r.text or "") for r in own.collect()]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = Counter(tuple(r) for r in token_count.token_counts(own, public_tokenizers.path("piece_bpe_32k.model"), 100).collect())
    assert got == Counter((i, len(t.encode()), n := len(sp.encode(t)), n > 100) for i, t in texts)
    want = Counter()
    for i, t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(own, path).collect()) == want
    assert Counter(tuple(r) for r in bpe.decode(bpe.encode(own, path), path).collect()) == Counter(texts)


def brute_contamination(tokens, typed, given, form):
    """Whether a document holds an item, by the rule of decontaminate.contamination() written plainly."""
    n, width = len(form), min(5, len(form))
    if not n:
        return False
    literal = lambda w: not w.startswith("#")
    item = [(k, tuple(form[k : k + width])) for k in range(n - width + 1) if sum(map(literal, form[k : k + width])) >= min(2, width)]
    bare = not item
    if bare:
        item = [(k, tuple(given[k : k + width])) for k in range(n - width + 1)]
    read = tokens if bare else typed
    places = sorted({k for k, _ in item})
    rank = {k: r for r, k in enumerate(places)}
    shifts = {}
    for p in range(len(read) - width + 1):
        for k, w in item:
            if tuple(read[p : p + width]) == w:
                held, ranks = shifts.setdefault(p - k, (set(), set()))
                held.add(w)
                ranks.add(rank[k])
    cells = {}
    for s in shifts:
        same = [0 <= i + s < len(typed) and typed[i + s] == form[i] for i in range(n)]
        cells[s] = [i for i in range(n) if same[i] and (n == 1 or (i and same[i - 1]) or (i + 1 < n and same[i + 1]))]
    held, whole = set(), False
    for kind in range(3):
        cell = lambda s: (math.floor(s / n), math.floor(s / n + 0.5), s)[kind]
        for at in set(map(cell, shifts)):
            own = [s for s in shifts if cell(s) == at]
            fill = {}
            for s in sorted(own, key=lambda s: (len(cells[s]), s)):
                fill.update({i: s for i in cells[s]})
            slots = Counter((given[i], tokens[i + s]) for i, s in fill.items() if form[i].startswith("#"))
            best = {g: max(c for (x, _), c in slots.items() if x == g) for g, _ in slots}
            if not slots or sum(best.values()) >= 0.8 * sum(slots.values()):
                for s in own:
                    held |= shifts[s][0]
                    need = min(9, len(places))
                    run = kind == 2 and any(set(range(r, r + need)) <= shifts[s][1] for r in shifts[s][1])
                    whole = whole or run or len(fill) >= 0.8 * n
    return whole or 2 * len(held) >= len({w for _, w in item})


def test_decontamination_equals_a_plain_computation(spark):
    r = random.Random(8)
    kind = ["10", "7km", "five", "Paris", "New York", "km", "train", "leaves", "from", "meets", "on", "monday", "after", "and"]
    items = [" ".join(["a", *(r.choice(kind) for _ in range(n))]) for n in (0, 1, 2, 3, 4, 8, 12, 20, 30, 45)] + ["12 13 14 15 16 17", "Say 5", "", None, items0 := "what is photosynthesis exactly?"]
    texts = []
    for t in items * 4:
        w = (t or "").split()
        for _ in range(r.randrange(4)):
            if w:
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = r.choice([[], [r.choice(kind)], [w[k]], [r.choice(kind), r.choice(kind)]])
        texts.append(" ".join([*(r.choice(kind) for _ in range(r.randrange(9))), *w, *(r.choice(kind) for _ in range(r.randrange(9)))]))
    texts += [f"we asked {items0} in class", "12 13 14 15 16 17", "22 23 24 25 26 27", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, doc_id int")

    def forms(df, key):
        both = df.select(key, decontaminate.marked_tokens(F.col("text")).alias("t")).select(key, "t", decontaminate.template(F.col("t")).alias("f"))
        return {x[0]: (x.t, x.f) for x in both.collect()}

    d, b = forms(docs, "doc_id"), forms(bench, "item_id")
    assert all(len(t) == len(f) for t, f in [*d.values(), *b.values()])
    want = {(i, j) for i, x in d.items() for j, y in b.items() if brute_contamination(*x, *y)}
    got = {(x.doc_id, x.item_id) for x in decontaminate.contamination(spark, docs, bench).collect()}
    assert got == want and len(want) > 40


def test_decontamination_forms(spark):
    """Short items inside texts, numbers with and without space before units, in words, and names of several words."""
    base = "a coach from {} to the coast covers {} before it stops near {} again for lunch"
    rows = [(1, base.format("New York", "7km", "New York")), (2, base.format("Paris", "five km", "Paris")), (3, base.format("Rio de Janeiro", "12 miles", "Oslo")), (4, "They asked: What is photosynthesis exactly? Nobody knew."), (5, "photosynthesis exactly what is")]
    bench = spark.createDataFrame([(1, base.format("London", "5 km", "London")), (2, "What is photosynthesis exactly?")], "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in decontaminate.flag(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got[1] == [1] and got[2] == [1] and got[4] == [2] and got[5] == []


def test_decontamination(spark):
    item = "a train leaves at 10 km from Paris and meets the other train after 20 minutes near Paris on monday evening"
    rows = [(1, item), (2, f"Intro here. {item.replace('10', '35').replace('Paris', 'London').replace('20', '7')} the end"), (3, item.replace("near Paris", "near Rome").replace("Paris and", "Oslo and")), (4, "nothing of it"), (5, None), (6, ""), (None, item), (7, item.upper())]
    bench = spark.createDataFrame([(9, item, "x"), (10, None, "x"), (11, "", "x")], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in decontaminate.flag(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(got) == 8 and got[1].item_ids == [9] and got[2].contaminated and not got[None].contaminated
    assert not any(got[k].contaminated for k in (4, 5, 6))
    assert decontaminate.contamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).count() == 0


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation files,
to deal in the Software
without restriction.
"""


def test_licenses(spark):
    long = " ".join(f"word{k % 97}" for k in range(3000))
    rows = {
        1: (f"{prose(20)}\nReleased under the MIT License.\nend", ["mit"], 1, 1),
        2: ("This work is licensed under the GNU General Public License, version 3.", ["gpl"], 1, 1),
        3: ("the license of the driver was valid\n" + prose(30), [], 0, 0),
        4: (None, [], 0, 0),
        5: ("", [], 0, 0),
        6: ("Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", ["cc-by-nc"], 1, 2),
        7: (MIT, ["mit"], 1, 1),
        8: ("MIT License\n\nnothing more", ["mit"], 1, 1),
        9: ("// SPDX-License-Identifier: Apache-2.0\nint main;", ["apache-2.0"], 1, 1),
        10: ("This is not released under the MIT License.", [], 0, 0),
        11: (f"{long} Licensed under the Apache License, Version 2.0. {long}", ["apache-2.0"], 1, 1),
        12: ("Licensed under CC BY-NC 4.0.\r\n\r\n \t\r\nAll rights reserved.", ["cc-by-nc", "proprietary"], 2, 2),
        13: ("\n\n \n", [], 0, 0),
        14: ("we wrote about the MIT License and why courts like it", [], 0, 0),
    }
    docs = spark.createDataFrame([(k, v[0], "clash") for k, v in rows.items()] + [(None, "Licensed under the Apache License, Version 2.0.", "x"), (1, rows[1][0], "x")], "doc_id long, text string, family string")
    model = licenses.train(spark, docs)
    got = licenses.licences(spark, docs, model).collect()
    assert len(got) == len(rows) + 2 and Counter(r.doc_id for r in got)[1] == 2
    for r in got:
        _, families, paragraphs, notices = rows.get(r.doc_id, (None, [], 0, 0))
        assert (r.families, r.n_paragraphs, r.n_notices) == (families, paragraphs, notices), r
        assert (r.probability is None) == (not families) and (not families or 0.5 <= r.probability <= 1)
    assert licenses.licences(spark, docs.limit(0), model).count() == 0


def test_licence_scores_equal_a_plain_computation(spark):
    """The joins against the model applied word by word in Python."""
    filler = [f"filler{k}" for k in range(40)]
    texts, want = [], []
    for n, (family, notices) in enumerate(licenses.NOTICES.items()):
        for i, t in enumerate(notices):
            before = filler[(n + i) % 20 :][: 3 + i]
            texts.append(" ".join([*before, t, *filler[:5]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.train(spark, docs)
    got = {(r.doc_id, r.at, r.family): r.probability for r in licenses.scan(spark, docs, model).collect()}
    grams = {(f, i): [tuple(w[k : k + 3]) for k in range(len(w) - 2)] for f, ts in licenses.NOTICES.items() for i, w in enumerate(map(licenses.words_of, ts))}
    sign = {g for gs in grams.values() for g in gs}
    for d, t in enumerate(texts):
        w = licenses.words_of(t)
        places = [k for k in range(len(w) - 2) if tuple(w[k : k + 3]) in sign]
        for (family, i), gs in grams.items():
            n = len(gs) + 2
            for half in (0, 0.5):
                cells = {}
                for k in places:
                    for pos in (p for p, g in enumerate(gs) if g == tuple(w[k : k + 3])):
                        cells.setdefault(math.floor((k - pos) / n + half), []).append((k, pos))
                for cell in cells.values():
                    if len({p for _, p in cell}) / len(gs) >= licenses.CONTAINMENT:
                        at, end = min(k for k, _ in cell), max(k for k, _ in cell) + 3
                        own = licenses.grams_of(w[max(0, at - licenses.CONTEXT) : end])
                        x = np.array(model.bias) + licenses.SCALE / math.sqrt(len(own)) * sum(np.array(model.weights[g]) for g in own if g in model.weights)
                        p = 1 / (1 + math.exp(-(model.curve[0] * (np.logaddexp.reduce(x[:-1]) - x[-1]) + model.curve[1])))
                        p *= math.exp(x[:-1].max() - np.logaddexp.reduce(x[:-1]))
                        if model.classes[int(x[:-1].argmax())] == family and p >= licenses.PROBABILITY:
                            want.append(((d, at, family), p, end))
    best, ends = {}, {}
    for key, p, end in want:
        best[key], ends[key] = max(p, best.get(key, 0)), max(end, ends.get(key, 0))
    best = {k: p for k, p in best.items() if not any(o[0] == k[0] and o[2] == k[2] and o[1] < k[1] < ends[o] for o in best)}
    assert len(best) >= 0.9 * len(texts) and got.keys() == best.keys()
    assert all(got[key] == pytest.approx(best[key]) for key in best)


def test_warc(spark, tmp_path):
    pages = [(k, f"http://x/{k}", rnd.choice(["<p>a</p>", "", None, "ż" * k, f"only {k}\r\n\r\n"])) for k in range(60)] + [(5, "http://again\r\nx", "<p>a</p>"), (None, None, "<p>none</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    first: dict = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault((h or "").encode(), i)
    for name in "ab":
        warc.write(spark, df, str(tmp_path / name))
    files = lambda name: {p.name: p.read_bytes() for p in (tmp_path / name).iterdir() if not p.name.endswith(".crc")}
    assert files("a") == files("b")
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(pages)
    for i, n, d in [(p[0], len((p[2] or "").encode()), warc.base32_sha1((p[2] or "").encode())) for p in pages if p[0] != 5]:
        r = next(r for r in got if r.page_id == i)
        raw = next((p[2] or "").encode() for p in pages if p[0] == i)
        assert (r.payload_bytes, r.payload_digest) == (n, d)
        if i is not None:
            assert r.refers_to == (None if first[raw] == i else first[raw]) and r.record_type == ("response" if first[raw] == i else "revisit")
        if r.record_type == "response":
            assert bytes(r.payload) == raw


def test_classifiers(spark):
    good = [(k, prose(40), "en", "a") for k in range(300)]
    bad = [(1000 + k, " ".join(w.upper() + "!!" for w in prose(40).split()), "en", "b") for k in range(100)]
    rude = [(2000 + k, prose(15) + " idiot moron " + prose(15), "en", "a") for k in range(100)]
    odd = [(5000, None, None, None), (5001, "", "en", "a"), (5002, prose(9000), "en", "a")]
    docs = spark.createDataFrame([*good, *bad, *rude, *odd], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[0] not in range(1000, 2000)), int(2000 <= r[0] < 5000)) for r in [*good, *bad, *rude] if r[0] % 2], "doc_id long, quality int, toxic int")
    tox = {r.doc_id: r for r in toxicity.score(spark, docs, toxicity.train(spark, docs, labels)).collect()}
    assert len(tox) == 503 and all(tox[r[0]].predicted == (2000 <= r[0] < 5000) for r in [*good, *bad, *rude])
    assert all(0 <= r.score <= 1 for r in tox.values())
    kept = {r.doc_id: r for r in quality.score(spark, docs, quality.train(spark, docs, labels)).collect()}
    assert len(kept) == 503 and sum(kept[r[0]].keep == (r[0] not in range(1000, 2000)) for r in [*good, *bad, *rude]) >= 495
    assert toxicity.score(spark, docs, toxicity.train(spark, docs, labels.limit(0))).where(F.col("score") != 0.5).count() == 0


def test_similar_groups_by_tables_equals_one_table(spark):
    """Narrow groups (several tables, crowded groups cut into cells) find what one group of all rows finds."""
    import random

    r = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    base = [[r.choice(words) for _ in range(120)] for _ in range(160)]
    near = [[*b[:k], "changed", *b[k + 1 :]] for b in base[:40] for k in (r.randrange(120),)]
    crowd = [[*base[0][:k], f"x{k}", *base[0][k + 1 :]] for k in range(0, 120)]
    rows = [(n, " ".join(t)) for n, t in enumerate([*base, *near, *crowd, base[3], []])] + [(None, "a b c"), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda n: {x.doc_id: x.component_id for x in simhash.similar_groups(spark, docs, group_rows=n).collect()}
    whole, cut = of(100_000), of(8)
    assert simhash._tables(300, 0.8, 1024, 8, 0.002)[1] > 10
    assert cut == whole and all(whole[160 + k] == k for k in range(1, 40)) and {whole[200 + k] for k in range(120)} == {0}


def test_similar_groups_equals_exact_jaccard(spark):
    """Pairs just at, over and under a Jaccard similarity of 0.8, short and long, against the sets themselves."""
    r, rows = random.Random(3), []

    def fresh(n):
        return [f"v{r.randrange(10**9)}" for _ in range(n)]

    for words, cut in [(9, 1), (19, 3), (10, 1), (11, 1), (104, 20), (454, 90), (454, 98), (454, 105), (34, 7)] * 12:
        base = fresh(words)
        rows += [" ".join(base), " ".join(base[:-cut])]
    hub = fresh(30)  # many texts that hold a long common passage and differ by the rest
    rows += [" ".join([*hub, *fresh(k % 9)]) for k in range(60)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in rows]
    want = groups_of(len(rows), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    for group_rows in (4096, 8):
        got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark, docs, group_rows=group_rows).collect()}
        assert [got[k] for k in range(len(rows))] == want


def test_decontamination_judges_each_occurrence(spark):
    item = "a train leaves at 10 km from Paris and meets the other train after 20 minutes near Paris on monday evening"
    other = item.replace("10", "35").replace("Paris", "London").replace("20", "7")
    phrase = "the cost is 10 and the cost is 20 and the cost is 30"
    again = "swap 5 for 5 and then 5 for 5 and once more 5 for 5 today"
    far = " ".join(f"filler{k} and meets the other train after {k} minutes near Oslo on" for k in range(40))
    rows = [(1, f"{item} {other}"), (2, f"first {other} then {item.replace('Paris', 'Madrid')} end"), (3, phrase), (4, f"{item} {far}"), (5, "swap 1 for 2 and then 3 for 4 and once more 6 for 7 today"), (6, far)]
    bench = spark.createDataFrame([(9, item), (10, phrase), (11, again)], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.flag(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got[1] == [9] and got[2] == [9] and got[3] == [10] and got[4] == [9] and got[5] == []


def test_decontamination_of_excerpts_and_edited_items(spark):
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(59)]
    long, short = " ".join(words), " ".join(f"term{chr(97 + k)}" for k in range(16))
    s = short.split()
    edited = " ".join([*s[:5], "other", *s[6:10], "changed", *s[11:]])
    moved = " ".join([*s[:5], "put", *s[5:10], *s[11:]])
    rows = [(1, f"before {' '.join(words[20:47])} after"), (2, f"before {edited} after"), (3, f"before {moved} after"), (4, f"x {' '.join(words[:13])} y"), (5, f"x {' '.join(words[:11])} y"), (6, f"x {' '.join(s[:5])} y")]
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.flag(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1], 2: [2], 3: [2], 4: [1], 5: [], 6: []}


def test_content_counts_capitals_of_the_whole_text():
    for small, capital in (("a", "B"), ("ż", "Ż")):
        text = "".join(capital if k % 4 else small for k in range(4096))  # a stride of 8 meets small letters only
        assert quality.capitals(text) == 3072
        of = lambda t: set(quality.Content()(t)[0].tolist())
        assert of(text) != of(text.lower())


def test_kneser_ney_raises_for_a_lost_shard(spark, docs):
    import os

    model = kneser_ney.train(spark, docs.where("doc_id < 50"), 2)
    names = sorted(os.listdir(model.path))
    assert any(n.startswith("2-") for n in names) and not any(n.endswith(".tmp") for n in names)
    for level in ("1-", "2-"):
        lost = [n for n in names if n.startswith(level) and n.endswith(".values.npy")]
        for n in lost:
            os.rename(f"{model.path}/{n}", f"{model.path}/lost-{n}")
        with pytest.raises(Exception, match="its file can't be seen"):
            kneser_ney.score(docs, model).collect()
        for n in lost:
            os.rename(f"{model.path}/lost-{n}", f"{model.path}/{n}")
    assert kneser_ney.score(docs, model).count() == docs.count()


def test_kneser_ney_counts_beyond_a_byte(spark):
    own = spark.createDataFrame([(1, "a b " * 700), (2, "c")], "doc_id long, text string")
    model = kneser_ney.train(spark, own, 2)
    got = {r.doc_id: r for r in kneser_ney.score(own, model).collect()}
    hashes = common.WordHashes()([b"a", b"b"])
    raw = model.look_up(2, kneser_ney.gram_hash(np.stack([hashes, hashes[::-1]])))
    assert raw[:, 0].tolist() == [700.0, 699.0] and got[1].n_known == 1401


def test_co_training_views_are_apart_and_use_all_unlabelled_rows(spark):
    # What tells quality stands in the text and, for the pages without labels, in the source too.
    good = [(k, prose(30), "en", f"good{k % 3}", 5) for k in range(400)]
    bad = [(1000 + k, " ".join(f"{w}$$$" for w in prose(30).split()), "en", f"bad{k % 3}", 5) for k in range(400)]
    odd = [(5000, None, None, None, None), (None, "", "en", "good1", 7), (5001, "z" * 50_000, "en", "bad1", -3), (5001, "z" * 50_000, "en", "bad1", -3)]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in [*good, *bad, *odd]], "doc_id long, text string, lang string, source string, n_chars long, keep string, score double")
    feats = common.cut(spark, quality.features(docs), "test-features")
    rows = feats.collect()
    assert len(rows) == len(good) + len(bad) + len(odd)
    by = {r.doc_id: r for r in rows}
    assert by[0].mi == by[3].mi and by[0].mi != by[1].mi and (by[0].ci, by[0].cv) != (by[3].ci, by[3].cv)  # the metadata view does not see the text
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in [*good, *bad] if r[0] % 3 == 0], "doc_id long, quality int")
    model = quality.train_on(spark, feats, labels)
    unlabelled = len(good) + len(bad) - labels.count()
    assert model["sure"][0][0] >= 0.8 * unlabelled  # the content view has labelled all that it is sure of, not a sample
    got = {r.doc_id: r for r in quality.score_on(spark, feats, model).collect()}
    assert sum(got[r[0]].keep == (r[0] < 1000) for r in [*good, *bad]) >= 0.99 * (len(good) + len(bad))
    # Without the text, the metadata view alone tells most pages.
    assert sum((got[r[0]].meta_score >= 0.5) == (r[0] < 1000) for r in [*good, *bad]) >= 0.95 * (len(good) + len(bad))
    assert quality.classify(spark, docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality.classify(spark, docs.limit(0), labels).count() == 0
    one = labels.where("quality = 1")
    assert quality.classify(spark, docs, one).count() == len(rows)


def test_toxicity_equals_plain_ftrl(spark):
    """Weights and scores against a per-coordinate learner written with dictionaries."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["idiot", "moron"]
    texts = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 25)))) for k in range(120)]
    docs = spark.createDataFrame([*texts, (None, "idiot"), (200, None), (201, "x" * 100_000), (0, "again idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("idiot" in t or "moron" in t)) for k, t in texts if k % 2] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(spark, docs, labels)
    grams, z, n, rows = toxicity.Grams(), Counter(), Counter(), []
    marks = {k: int("idiot" in t or "moron" in t) for k, t in texts if k % 2}
    for k, t in sorted(texts):
        if k in marks:
            rows.append((sorted(set(grams(t).tolist())), marks[k]))
    order = np.random.default_rng(11)

    def weight(i, l1):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / 0.5)

    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            w = {i: weight(i, 4.0) for i in x}
            w["bias"] = weight("bias", 0.0)
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w[i]
                n[i] += g * g
    want = {i: weight(i, 4.0) for i in z if i != "bias" and weight(i, 4.0)}
    assert dict(zip(model[0], model[1])) == pytest.approx(want) and model[2] == pytest.approx(weight("bias", 0.0))
    for row in toxicity.score(spark, docs, model).join(docs.withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i"))).collect():
        if row.doc_id != 0:
            p = 1 / (1 + math.exp(-(weight("bias", 0.0) + sum(want.get(i, 0) for i in set(grams(row.text or "").tolist())))))
            assert row.score == pytest.approx(p) and row.predicted == int(p >= 0.3)
    assert toxicity.score(spark, docs.limit(0), model).count() == 0


def test_token_counts_tell_words_of_one_hash_apart(spark, monkeypatch, tmp_path):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "hello extraordinary hello"), (2, "")], "doc_id long, text string")
    folder, shards = token_count.piece_table(df, path)
    own = [b"hello", b"extraordinary"]
    keys, counts = token_count._hash(own), np.array([len(sentencepiece.SentencePieceProcessor(model_file=path).encode(w.decode())) for w in own])
    pieces = token_count.Pieces(folder, shards)
    assert pieces.total(Counter({"hello": 2, "extraordinary": 1})) == 2 * counts[0] + counts[1] and shards == 1
    with pytest.raises(LookupError):
        pieces.look_up(["absent"])
    pieces.open[0] = (np.sort(keys), np.array([9, 9]), {b"hello": 3})
    pieces.known.clear()
    assert pieces.total(Counter({"hello": 1, "extraordinary": 1})) == 12
    assert token_count.token_counts(df.limit(0), path).count() == 0
