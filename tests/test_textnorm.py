import unicodedata

from pyspark.sql import functions as F

from lexiforge.functions import textnorm as tn
from lexiforge.functions.similarity import indel_ratio
from lexiforge.operators.schema import lcs


def run(spark, texts, config):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, keyword string")
    return [(r.normalized_keyword, r.normalization_trace) for r in tn.normalise(df, config=config).orderBy("row_id").collect()]


def test_all_rules_together(spark):
    config = tn.NormalizerConfig(company_dictionary={"lenovo legion": "legion"}, lemmas=True, stop_words=True, token_sort=True)
    texts = ["Lenovo-Laptop", "  Gaming   LAPTOPS ", None, "", "Ergo_Mouse", "usb stick DRIVE", "mice", "Batteries", "café", "ThinkPad T14", "0500 GB ssd drive"]
    got = [t for t, _ in run(spark, texts, config)]
    assert got[0] == "laptop lenovo" and got[2] == got[3] == "" and got[6:10] == ["mouse", "battery", "cafe", "t14 thinkpad"]
    assert got[4] == "ergonomic mouse" and got[10] == "500gb ssd"


def test_zeros_and_trace(spark):
    got = run(spark, ["02tb", "0016gb", "t14", "thinkpad t014", "Ergo-Mouse"], tn.NormalizerConfig())
    assert [t for t, _ in got[:4]] == ["2tb", "16gb", "t14", "thinkpad t014"]
    assert got[4] == ("ergonomic mouse", "case -> punctuation -> dictionary")


def test_unicode_fold_over_the_basic_plane(spark):
    chars = [chr(c) for c in range(1, 0xFFFE) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chars)], "i long, c string").select("i", tn.fold_unicode(F.col("c")).alias("f"))
    got = {r.i: r.f for r in df.collect()}
    for i, c in enumerate(chars):
        assert got[i] == "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80"), hex(ord(c))


def test_indel_ratio_equals_the_plain_programme(spark):
    words = ["", "a", "laptop", "laptops", "x" * 70, "x" * 69 + "y", "gaming laptop 16gb", "laptop gaming 16 gb", "äöü", "aöü"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").withColumn("r", indel_ratio("a", "b"))
    for r in df.collect():
        total = len(r.a) + len(r.b)
        assert abs(r.r - (200.0 * lcs(r.a, r.b) / total if total else 100.0)) < 1e-9, (r.a, r.b)


def test_small_functions(spark):
    df = spark.createDataFrame([("Artificial Intelligence", "1.2.3"), ("One", "1.2"), (None, None)], "a string, b string")
    rows = df.select(tn.acronym(F.col("a")).alias("x"), tn.is_semver(F.col("b")).alias("v"), tn.truncated(F.col("a"), 10).alias("t"), tn.title_case(F.lit("9i o'neil x")).alias("c")).collect()
    assert [tuple(r)[:3] for r in rows] == [("AI", True, "Artific..."), (None, False, "One"), (None, None, None)] and rows[0].c == "9I O'Neil X"
