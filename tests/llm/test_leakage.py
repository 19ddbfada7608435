import random

import numpy as np

from lexiforge.llm import leakage

DOCS = "doc_id long, text string, source string, item_id string"
ITEMS = "item_id long, suite string, text string, answer string"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so", "tu", "va", "ze") for b in ("bar", "den", "fin", "gol", "hun", "jat", "kip", "lom")]
COMMON = [f"common{i}" for i in range(300)]


def brute(docs, items):
    grams = {}
    for i, _, t, _ in items:
        w = leakage.words_of(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = leakage.words_of(t)
        for k in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return out


def build(seed=1):
    rng = random.Random(seed)
    items = [(i, "s", " ".join(rng.choice(WORDS) for _ in range(60)), str(rng.randint(100, 999))) for i in range(40)]
    docs = []
    for d in range(600):
        w = [rng.choice(COMMON) for _ in range(rng.randint(30, 300))]
        if d % 6 == 0:
            _, _, t, _ = rng.choice(items)
            t = t.split()
            n = rng.choice([8, 11, 12, 13, 20, 60])
            s = rng.randrange(len(t) - n + 1)
            k = rng.randrange(len(w))
            piece = t[s : s + n]
            w[k:k] = [x.upper() if rng.random() < 0.2 else x + rng.choice(["", ",", "."]) for x in piece]
        docs.append((d, " ".join(w), "x", "clash"))
    return docs, items


def test_no_leak_is_lost_and_none_invented(spark):
    docs, items = build()
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_runs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = brute(docs, items)
    assert len(want) > 40 and got == want


def test_odd_documents(spark):
    _, items = build()
    text = items[3][2]
    docs = [(1, None, "a", ""), (2, "", "a", ""), (3, "x" * 300_000, "a", ""), (4, "word " * 60_000 + text + " word" * 60_000, "a", ""), (5, text, "a", ""), (6, text, "a", "")]
    items += [(90, "s", None, None), (91, "s", "short item", "1"), (92, "s", text, None)]
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_runs(df, it).collect()}
    assert got == {(d, i) for d in (4, 5, 6) for i in (3, 92)}
    assert leakage.search(df.limit(0), it).collect() == [] and leakage.search(df, it.limit(0)).collect() == []


def test_runs_of_frequent_words_between_rare_ones(spark):
    rng = random.Random(8)
    usual = [f"usual{i}" for i in range(60)]
    items = [(i, "s", " ".join(rng.choice(usual) for _ in range(50)), "1") for i in range(20)]
    docs = []
    for d in range(400):
        w = [rng.choice(usual) for _ in range(40)] + [f"rare{d}x{k}" for k in range(40)]
        rng.shuffle(w)
        if d % 8 == 0:
            t = rng.choice(items)[2].split()
            s = rng.randrange(len(t) - 12)
            w[20:20] = t[s : s + 12]
        docs.append((d, " ".join(w), "x", ""))
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_runs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = brute(docs, items)
    assert len(want) >= 50 and got == want


def test_paraphrases_need_the_subsequence_and_the_answer(spark):
    docs, items = build(5)
    rng = random.Random(6)
    docs = [d for d in docs if d[0] % 6]
    planted = set()
    for n in range(30):
        i, _, t, answer = items[n]
        w = t.split()
        for k in range(5, len(w), 6):  # every run is broken
            w[k] = rng.choice(COMMON)
        told = n % 3 != 0
        if told:
            planted.add((10_000 + n, i))
        docs.append((10_000 + n, " ".join([*rng.sample(COMMON, 40), *w, "so", answer if told else "none", *rng.sample(COMMON, 40)]), "x", ""))
    found = leakage.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    got = {(r.doc_id, r.item_id) for r in found if r.doc_id >= 10_000}
    assert got == planted and all(r.longest_run < 12 and r.lcs_share >= 0.7 and r.has_answer for r in found)


def test_blocks_of_items_and_long_runs(spark):
    docs, items = build(7)
    long = " ".join(f"word{i}" for i in range(3_000))
    items.append((99, "s", long, "1"))
    docs.append((9_999, "before " + long + " after", "x", ""))
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = leakage.search(df, it, max_items=9).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.longest_run >= 12} == brute(docs, items)
    assert next(r.longest_run for r in found if r.doc_id == 9_999) == 3_000


def test_basis_is_near_the_exact_singular_space(spark):
    docs, items = build(2)
    df = spark.createDataFrame(docs, DOCS)
    idf = leakage.inverse_frequencies(df)
    q = leakage.latent_basis([t for _, _, t, _ in items], df, idf, rank=64)
    assert np.allclose(q.T @ q, np.eye(64), atol=1e-3)
    rows = [(d, w) for _, _, d, w in leakage._passage_vectors([t for _, _, t, _ in items], idf, leakage.Hasher())]
    kept = np.mean([np.linalg.norm(w @ q[d]) ** 2 for d, w in rows])
    assert kept > 0.5


def test_runs_and_subsequences():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        runs = max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if any(b[j : j + n] == a[i : i + n] for j in range(len(b)))), default=0)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leakage.longest_run(a, b) == runs and leakage.common_subsequence(a, b) == table[-1][-1]
