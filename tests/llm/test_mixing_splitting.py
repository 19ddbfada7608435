import random

from lexiforge.llm import mixing, splitting, tokens

DOCS = "doc_id long, text string, source string, n_tokens string, steps string"
PLAN = "source string, target_share double, max_repeats long, max_tokens long, overlap_tokens long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, (t, s) in enumerate(rows)], DOCS)


def mean(base, steps):
    return base + sum(1 - s for s in steps)


def test_poisson_steps_of_any_rate_and_cap():
    for lam in (0.0, 0.3, 1.0, 7.5, 60.0):
        base, steps = mixing.poisson_steps(lam, 10_000)
        assert base == 0 and abs(mean(base, steps) - lam) < 1e-9
    for lam in (800.0, 1500.0, 5e5):  # beyond what exp(-lam) can hold
        base, steps = mixing.poisson_steps(lam, 10**9)
        assert abs(mean(base, steps) / lam - 1) < 1e-9
        assert abs(sum(2 * (base + k) * (1 - s) for k, s in enumerate(steps)) + base * base + sum(1 - s for s in steps) - lam * lam - lam) / lam**2 < 1e-6
    assert mixing.poisson_steps(800.0, 500)[0] == 479 or mean(*mixing.poisson_steps(800.0, 500)) <= 500


def test_calibration_meets_the_wanted_size():
    rng = random.Random(3)
    for cap in (1, 3, 10, 2_000):
        tokens_ = [rng.choice([0, 5, 5, 900]) for _ in range(mixing.BUCKETS)]
        own = sum(tokens_)
        for rate in (0.0, 0.1, 0.7, 1.5, 800.0):
            if rate < cap:
                base, steps = mixing.calibrated(tokens_, rate * own, cap)
                got = sum(n * (base + sum((k + 0.5) / mixing.BUCKETS >= s for s in steps)) for k, n in enumerate(tokens_))
                assert abs(got - rate * own) <= 0.002 * own * max(1, rate) + 1_800
        assert mixing.calibrated(tokens_, cap * own, cap) == (cap, [])


def test_large_caps_are_not_cut(spark):
    rows = [("lamp", "tiny"), ("lamp " * 200_000, "huge")]
    plan = spark.createDataFrame([("tiny", 0.2, 100_000, 9, 0), ("huge", 0.8, 5, 9, 0)], PLAN)
    got = {r.source: r for r in mixing.shares(docs(spark, rows), plan).collect()}
    assert got["tiny"].reachable and got["tiny"].n_copies > 10_000


def test_shares_are_met_and_caps_kept(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(["lamp", "router", "desk"]) for _ in range(rng.randint(5, 60))), rng.choice(["big"] * 8 + ["mid", "small"])) for _ in range(4000)]
    rows += [(None, "big"), ("", "mid"), ("unplanned text", "other"), ("no source", None)]
    plan = spark.createDataFrame([("big", 0.5, 2, 9, 0), ("mid", 0.3, 5, 9, 0), ("small", 0.2, 1, 9, 0), ("none", 0.0, 1, 9, 0)], PLAN)
    df = docs(spark, rows)
    got = {r.source: r for r in mixing.shares(df, plan).collect()}
    assert {s for s in got if not got[s].reachable} == {"small"}
    reached = {s: got[s].n_tokens for s in got}
    whole = sum(tokens_of(rows).values())
    left = whole - reached["small"]  # handed on in proportion
    assert abs(reached["big"] / (left * 5 / 8) - 1) < 0.01 and abs(reached["mid"] / (left * 3 / 8) - 1) < 0.01
    assert all(abs(got[s].actual_share - got[s].given_share) < 0.005 for s in got)
    assert got["small"].n_copies == got["small"].n_docs and got["none"].n_tokens == 0
    drawn = mixing.mix(df, plan).select("doc_id", "source", "copy_no", "place").collect()
    most = {"big": 2, "mid": 5, "small": 1}
    assert all(r.copy_no <= most[r.source] for r in drawn) and len({(r.doc_id, r.copy_no) for r in drawn}) == len(drawn)
    again = mixing.mix(df.repartition(9), plan).select("doc_id", "source", "copy_no", "place").collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))
    assert mixing.mix(df.limit(0), plan).collect() == []


def tokens_of(rows):
    enc = tokens.encoding(tokens.TOKENIZER)
    out = {}
    for t, s in rows:
        out[s] = out.get(s, 0) + (len(enc.encode_ordinary(t)) if t else 0)
    return out


def check(text, limit, overlap, enc):
    size = lambda t: len(enc.encode_ordinary(t))
    pieces = splitting.split_text(text, limit, overlap, enc)
    if size(text) <= limit:
        assert pieces == []
        return pieces
    assert pieces[0][0] == 0 and pieces[-1][2] == len(text)
    for start, own, end, n, shared in pieces:
        assert start <= own < end and n == size(text[start:end]) <= limit and shared == size(text[start:own])
    room = limit - max(1, limit // 10)
    for k, (a, b) in enumerate(zip(pieces, pieces[1:]), 1):
        assert a[2] == b[1]
        wanted = min(overlap, room, size(text[: b[1]]))
        full = size(text[b[1] : b[2]])
        # the shared tokens are all there unless text and overlap together have no room
        assert b[4] >= min(wanted, limit - full) - 5, (k, b, wanted, full)
        assert b[4] <= overlap + 26
    return pieces


def test_overlaps_reach_over_small_pieces_and_are_large():
    enc = tokens.encoding(tokens.TOKENIZER)
    para = "This is a sentence of some words and it goes on for a while. "
    text = "\n\n".join(x for _ in range(8) for x in (para * 4, "Short."))
    for limit, overlap in ((60, 20), (100, 80), (64, 50), (40, 400)):
        check(text, limit, overlap, enc)
    for _, own, _, _, shared in splitting.split_text(text, 100, 80, enc)[1:]:
        assert shared >= min(78, len(enc.encode_ordinary(text[:own])) - 2)


def test_pieces_fit_cover_and_overlap():
    enc = tokens.encoding(tokens.TOKENIZER)
    rng = random.Random(2)
    words = ["lamp", "router.", "Tastatur,", "für", "モニターが安い。", "\n\n", "\n", "x" * 40, "👩‍💻", "é"]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 900)))
        limit = rng.choice([16, 40, 128])
        pieces = check(text, limit, rng.choice([0, 5, limit // 4]), enc)
        if len(pieces) > 2:
            assert sum(p[3] for p in pieces) / len(pieces) > 0.4 * limit
    check("a" * 20_000, 64, 8, enc)
    check("模型" * 4000, 32, 4, enc)


def test_cuts_prefer_paragraphs():
    enc = tokens.encoding(tokens.TOKENIZER)
    para = "This is a sentence of some words. Here is another one of them. "
    text = "\n\n".join(para.strip() for _ in range(12))
    for _, own, *_ in splitting.split_text(text, 70, 0, enc)[1:]:
        assert text[own - 2 : own] == "\n\n"


def test_split_table(spark):
    plan = spark.createDataFrame([("a", 0.5, 1, 20, None), ("b", 0.5, 1, None, 4)], PLAN)
    rows = [("one two three. " * 30, "a"), ("short", "a"), ("long " * 500, "b"), ("long " * 500, None), (None, "a"), ("", "a"), ("one two three. " * 30, "a")]
    df = docs(spark, rows)
    assert {r.doc_id for r in splitting.oversized(df, plan).collect()} == {0, 6}
    pieces = splitting.split(df, plan).filter("doc_id = 0").orderBy("piece_no").collect()
    assert "".join(p.piece[p.overlap_chars :] for p in pieces) == rows[0][0] and all(p.n_tokens <= 20 and p.n_pieces == len(pieces) for p in pieces)
    assert splitting.split(df.limit(0), plan).collect() == []
