import unicodedata

from lexiforge.llm import lookalikes as lk

CASES = {
    "ｂｅｓｔ laptop": "best laptop", "usb​hub": "usbhub", "a b": "a b", "café": "café", "fοr kids": "for kids", "сlеan": "clean", "ТОР rated": "TOP rated",
    "ﾉｰﾄﾊﾟｿｺﾝ": "ノートパソコン", "ｶﾞｰﾄﾞ": "ガード", "𝚐𝚊𝚖𝚒𝚗𝚐": "gaming", "oﬃce": "office", "нayшники": "наушники", "φoρητός": "φορητός", "c большой": "с большой", "ruvоrіtɑ": "ruvorita",
    "trѐs": "très", "a　b": "a b", "йод": "йод", "soft­hyphen": "softhyphen", "dell c экраном": "dell с экраном", "hid\U000E0061den": "hidden", "\ue0001 u\u200bp": "\ue0001 up",
}
FINE = [
    "", "plain", "two  blanks", "tab\tand\nbreak", "CAFÉ", "12 m²", "½ l", "brand™ ® n°2", "👩‍💻 laptop", "наушники с большой батареей", "Tamilowick наушники", "роутер usb c 16gb", "кабель usb c", "кабель hdmi c", "\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F hoodie", "\ue000 own \ue001 signs \ue002", "\ue0001 x \ue0002",
    "για γραφείο 4k", "Velavata ακουστικά", "ノートパソコン 安い", "प्रौद्योगिकी क्‍ष", "می‌خواهم",
]


def test_cases_and_ordinary_texts(spark):
    texts = [*CASES, *FINE, None, "ｘ" * 50_000]
    df = spark.createDataFrame([("t", i, x, 1) for i, x in enumerate(texts)], "src string, row_id long, keyword string, unified int")
    got = {r.row_id: r for r in lk.unify(df).collect()}
    for i, x in enumerate(texts):
        if x in CASES:
            assert (got[i].unified, got[i].disguised) == (CASES[x], True), x
        elif x in FINE:
            assert not got[i].disguised, x
    assert got[len(texts) - 2].unified is None and not got[len(texts) - 2].disguised
    assert got[len(texts) - 1].unified == "x" * 50_000
    assert lk.unify(df.limit(0)).collect() == []


def test_one_form_is_stable_and_tables_follow_unicode(spark):
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(CASES.values())], "src string, row_id long, keyword string")
    assert not any(r.disguised for r in lk.unify(df).collect())
    one, to, multi, _ = lk.compat_tables()
    assert len(one) == len(to)
    for a, b in [*zip(one, to), *multi]:
        assert a in "ﾞﾟ" or unicodedata.normalize("NFKC", a) == b
