import random

from lexiforge.llm import canonical_terms as ct

TERMS = [
    (1, "brand", "Snorandoq", ["SNR"]), (2, "brand", "Velopibo Labs", []), (3, "brand", "Hoxansagard Systems", ["HXNS"]), (4, "category", "Smart Label Makers", ["SMLAMA"]),
    (5, "category", "Travel Power Banks", []), (6, "category", "Travel Webcams", []), (7, "category", "Curved Monitors", []),
]
BOTH = ("brand", "category")


def test_writings_of_a_name():
    m = ct.TermMatcher(TERMS)
    for value, term in {
        "snorandoq": 1, " Snorandoq® ": 1, "SNORANDOQ GmbH": 1, "by snorandoq": 1, "S.N.R.": 1, "(snr)": 1, "Sn0randoq": 1, "snorandqo": 1, "snórandöq": 1,
        "Labs, Velopibo": 2, "velopibolabs": 2, "velopibo_labs.": 2, "VelopiboL abs": 2, "Smar. Labe. Make.": 4, "smart label maker": 4, "travel-power-banks > ": 5,
        "Trave1 Webcarns": 6, "curvde montors": 7, "our curved monitors & accessories": 7,
    }.items():
        assert m.lookup(value, BOTH) == term, value


def test_values_that_name_nothing():
    m = ct.TermMatcher(TERMS)
    for value in ["", "  ", "--", "other", "Fishing Lures", "Velopibo Systems", "Hoxansagard Optics", "Travel", "Snorabbaq", "Curved Monitors and Travel Webcams", "x" * 100_000, "word " * 50_000]:
        assert m.lookup(value, BOTH) == -1, value[:40]
    assert m.lookup("Travel Webcams", ("brand",)) == -1 and m.lookup("Snorandoq", ("category",)) == -1
    assert ct.TermMatcher([]).lookup("Snorandoq", BOTH) == -1
    assert ct.TermMatcher([(1, "brand", "Twin A", []), (2, "brand", "Twin B", [])]).lookup("twin", BOTH) == -1


def test_edits_equal_the_plain_programme():
    def plain(a, b):
        d = {}
        for i in range(-1, len(a)):
            for j in range(-1, len(b)):
                if i < 0 or j < 0:
                    d[i, j] = i + j + 2 if i < 0 or j < 0 else 0
                    d[i, j] = max(i, j) + 1
                    continue
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
                if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert ct.edits(a, b, 3) == min(4, plain(a, b)), (a, b)


def test_misspellings_are_found_again():
    rng = random.Random(7)
    m, right, n = ct.TermMatcher(TERMS), 0, 0
    for tid, kind, name, _ in TERMS:
        for _ in range(100):
            w = list(name)
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(w) - 1)
                w[k : k + 2] = rng.choice([[w[k + 1], w[k]], [w[k]], [w[k], rng.choice("aeioxq"), w[k + 1]], [rng.choice("aeiox"), w[k + 1]]])
            n += 1
            right += m.lookup("".join(w), (kind,)) == tid
    assert right / n > 0.95


def test_length_is_no_limit():
    m = ct.TermMatcher(TERMS)
    assert m.lookup("the " * 15 + "Snorandqo " + "shop " * 15, BOTH) == 1  # words around a name
    long = [(9, "brand", "Verylongbrandnamethatgoesonforfortyfivelettersandmore", [])]
    m = ct.TermMatcher(TERMS + long)
    assert m.lookup("Verylongbrandnamethatgoesonforfortyfivelettresandmroe", BOTH) == 9
    assert m.lookup("Verylongbrand namethatgoesonfor fortyfivelettresandmroe", BOTH) == 9


def test_three_edits_are_found_wherever_they_stand():
    rng = random.Random(3)
    m = ct.TermMatcher([(1, "brand", "Hoxansagardin", []), (2, "brand", "Brilumetofax", [])])
    for _ in range(300):
        w = list("hoxansagardin")
        places = sorted(rng.sample(range(0, 12, 2), 3), reverse=True)
        for k, edit in zip(places, rng.sample(["drop", "drop", "add"], 3)):
            w[k : k + 1] = [] if edit == "drop" else [w[k], "z"]
        assert m.lookup("".join(w), ("brand",)) == 1, "".join(w)


def test_tables_with_nulls_and_clashing_columns(spark):
    terms = spark.createDataFrame(TERMS, "term_id long, kind string, term_name string, short_forms array<string>")
    ctx = spark.createDataFrame([(1, "snr", None, "c"), (2, "Snorandoq", "nothing", "c"), (3, None, "Travel Webcams", "c"), *[(i, "tst", None, "c") for i in range(10, 400)]], "context_id long, brand string, category string, value string")
    al = spark.createDataFrame([(9, "curved monitor", "x")], "alias_id long, base string, field string")
    got = {(r.field, r.record_id): r.term_id for r in ct.map_values(ct.free_values(ctx, al, terms), terms).collect()}
    assert got == {("brand", 1): 1, ("category", 2): -1, ("alias", 9): 7, **{("brand", i): -1 for i in range(10, 400)}}
    report = {(r.field, r.value): r.n for r in ct.unmatched_report(ct.map_values(ct.free_values(ctx, al, terms), terms)).collect()}
    assert report == {("category", "nothing"): 1, ("brand", "tst"): 390}
    assert ct.map_values(ct.free_values(ctx.limit(0), al.limit(0), terms.limit(0)), terms.limit(0)).collect() == []
