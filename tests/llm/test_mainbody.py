import random

from lexiforge.llm import mainbody

SCHEMA = "page_id long, source_url string, html string, block_no string"


def site(host, n, first, rng):
    nouns = ["monitor", "laptop", "chair", "lamp", "router", "keyboard", "scanner", "tablet", "desk", "printer"]
    text = lambda k: " ".join(rng.choice(nouns) + str(rng.randint(0, 99)) for _ in range(k))
    out = []
    for i in range(n):
        b, want, no = [], set(), 0

        def block(tag, body, main=False):
            nonlocal no
            b.append(f'<{tag} data-n="{no}">{body}</{tag}>')
            if main:
                want.add(no)
            no += 1

        b.append("<div class=x1>")
        for label in ("Home", "Shop", "Contact", "Careers"):
            block("li", f'<a href="/{label}">{label}</a>')
        b.append("</div><div class=x2>")
        block("p", f"Home &gt; Shop &gt; Guide {i}")
        block("h1", f"Guide {i} to {text(2)}", True)
        for _ in range(rng.randint(1, 4)):
            block("p", text(12) + " <b>now</b>.", True)
        block("h2", "Details", True)
        block("p", text(9), True)
        b.append("<ul>")
        block("li", f'<a href="/p/{i}">{text(3)}</a>', True)
        block("li", text(3), True)
        b.append("</ul>")
        block("span", "Print")
        b.append("</div><div class=x2>")
        block("h3", "Related pages")
        for _ in range(4):
            block("li", f'<a href="/p/{rng.randint(1, 9999)}">{text(6)}</a>')
        block("p", f"Free shipping for orders over {rng.randint(1, 99)} credits this month only.")
        b.append("</div><div>")
        block("span", f"{host.split('.')[1].title()}, all rights reserved")
        b.append("</div>")
        out.append((first + i, f"https://{host}/guide/{i}", f"<html><body><script>var t='<p>no</p>';</script>{''.join(b)}</body></html>", "clash", want))
    return out


def test_body_is_kept_and_furniture_removed(spark):
    rng = random.Random(3)
    pages = site("www.bigshop.example", 60, 0, rng)
    for k in range(40):
        pages += site(f"www.shop{chr(97 + k % 26)}{k}.example", 2, 1000 + 10 * k, rng)
    df = spark.createDataFrame([p[:4] for p in pages], SCHEMA)
    got = {(r.page_id, r.block_no) for r in mainbody.main_blocks(df).collect()}
    want = {(p[0], n) for p in pages for n in p[4]}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(got)
    texts = {r.page_id: r.main_text for r in mainbody.main_text(df, mainbody.main_blocks(df)).collect()}
    assert len(texts) == len(pages) and texts[0].startswith("Guide 0") and "Print" not in texts[0]


def test_element_nodes_carry_presentation_and_places(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([p[:4] for p in site("www.bigshop.example", 60, 0, rng)], SCHEMA)
    menu, lists = "<div class=x1>", "<div class=x3>"
    html = df.selectExpr("page_id", "source_url", "replace(html, '</div><div class=x2><h3', '</div><div class=x3><h3') as html").selectExpr("page_id", "source_url", "if(page_id % 2 = 0, replace(html, '<h2 ', '<h4 '), html) as html")
    tree = {r.element: r for r in mainbody.style_tree(mainbody.parse(html)).collect()}
    path = lambda tag: next(b.path for b in mainbody.read_blocks(f"<html><body>{tag}<p data-n=1>x</p>")) - (1 << 63)
    own = tree[path("<div class=x2>")]
    assert tree[path(menu)].composite < 0.05 and own.composite > 0.4 and 0.1 < own.presentation < 0.2  # two ways, log 2 / log 60
    assert tree[path(menu)].pages == own.pages == 60
    # a list of ever other pages says nothing new, though its texts differ from page to page
    assert tree[path(lists)].composite < 0.2


def test_more_than_a_thousand_headings(spark):
    html = "<div>" + "".join(f"<h2 data-n={2 * i}>Part {i} of it</h2><p data-n={2 * i + 1}>unlike text {i * 7919}</p>" for i in range(1_500)) + "</div>"
    assert len({b.branch for b in mainbody.read_blocks(html)}) == 1_500
    df = spark.createDataFrame([(1, "https://a.example/x", html, "")], SCHEMA)
    assert mainbody.main_blocks(df).count() == 3_000


def test_odd_pages(spark):
    rows = [(1, None, None, ""), (2, "https://a.example/x", "", ""), (3, "no url", "<p data-n=0>One text alone", ""), (4, "https://a.example/y", "<p data-n='1'>a < b & c</p>" + "<div>" * 3000 + "<p data-n='2'>deep</p>", ""),
            (5, "https://a.example/z", "<h2 data-n='0'></h2><p>no number</p>", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.page_id, r.block_no) for r in mainbody.main_blocks(df).collect()}
    assert (3, 0) in got and not {p for p, _ in got} & {1, 2, 5}
    assert mainbody.main_blocks(df.limit(0)).collect() == []


def test_untidy_markup_is_read():
    html = "<div><p data-n=1>one<p data-n=2>two <a href='/x'>link</a><ul><li data-n=3>three</ul></div><td data-n=4>four"
    assert [(b.no, " ".join("".join(b.parts).split()), b.linked > 0) for b in mainbody.read_blocks(html)] == [(1, "one", False), (2, "two link", True), (3, "three", False), (4, "four", False)]


def test_texts_and_containers_that_recur_are_read_once():
    """Every page of a site used to have its menu masked and its containers' paths hashed again."""
    page = lambda i: f"<body><div class='Menu'><a href='/p/{i}?x=1' data-n=1>Foobar news 1 2 3 today</a></div><p data-n=2>Text {i} of FOOBAR, four words</p></body>"
    mainbody._path.cache_clear()
    mainbody._text_key.cache_clear()
    got = [mainbody.features(page(i), "www.foobar.com") for i in range(40)]
    assert mainbody._path.cache_info().misses == 2 and mainbody._text_key.cache_info().misses == 41
    # digits and the site's name are masked, in any case of its letters, and for other sites it is a word
    assert len({x[0][1] for x in got}) == len({x[1][1] for x in got}) == len({x[0][3] for x in got}) == 1
    assert mainbody._text_key("FOOBAR é news of 12 days", "foobar") == mainbody._text_key("foobar É news of 7 days", "foobar") != mainbody._text_key("FOOBAR é news of 12 days", "")
    assert mainbody._text_key("Koobar é", "koobar") == mainbody._text_key("@ é", "koobar")
    assert [b.parts for b in mainbody.read_blocks("before<p data-n=1>a<b>c</b> </p>out<p data-n=2>behind the last tag")] == [["a", "c"], ["behind the last tag"]]
