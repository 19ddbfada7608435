"""Main body of web pages by a site style tree.

Each page is read into a tree of containers, heading branches and content blocks (one pass, untidy markup allowed). The trees
of a host are merged node by node:
- an element node is a container under its path of tags, classes, ids and roles. Its presentation importance is the entropy of the
  ways in which pages fill it (the sequence of its blocks' tags), its content importance one minus the mean entropy of what stands in
  it, and the composite importance weighs both by the number of its blocks;
- a leaf is a block's text; its importance is one minus the entropy of the pages that carry it. A linked text stands in its
  element as the place it leads to, numbers masked, so a list of ever other pages is presentation and no content;
- a heading opens a branch in its container; branches of one heading are merged over all pages that open one and have the share of their
  plain, unlinked content. Hosts with few pages lean on the leaves of all hosts and on the page itself.
Branches of low importance are removed from each page, then low leaves from the branches kept.

Statistics are reduced on the map side and cover all pages; a host with a third of all pages is counted like any other, and its
pages are joined to its tree by broadcast where they lie. What is broadcast is what at least a fixed share of all pages repeats, or the tree of a host
that has at least a thousandth of all pages, so its size is bounded by the blocks of a page over that share. Null or empty html has no blocks;
repeated pages count as pages; blocks without a number aren't reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.runtime import cut, join_unique

TREE_PAGES = 64  # pages beyond which a merged tree has no finer entropy
PRIOR_PAGES = 16  # weight of the leaves of all hosts in a host's tree, and of the page itself against its element nodes
PRIOR_WORDS = 12  # weight of a merged branch or element against the words of the page
LEAF, LONG_LEAF = 0.5, 0.65  # least importance of leaves of one word and of many
BRANCH, ELEMENT = 0.4, 0.2  # least importance of branches with a heading and of elements
DAMPING = 0.98  # of the children's share in the composite importance, for each block
GLOBAL_SHARE = 0.005
# Elements that hold blocks, and headings.
CONTAINERS = frozenset(
    "html body div section main article aside header footer nav ul ol dl table thead tbody tr td th noscript form blockquote figure".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SILENT = re.compile(r"<!--.*?-->|<(script|style|template|svg)\b.*?</\1\s*>", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>")
NUMBER = re.compile(r"""data-n\s*=\s*["']?(\d+)""")
DIGITS = re.compile(r"\d+")
STEP = re.compile(r"\s[>»›/]\s")
STYLE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HREF = re.compile(r"""\bhref\s*=\s*["']?([^"'\s>?#]*)""", re.I)
ANCHORED, HEADING, TOP_HEADING = 1, 2, 4
#: Containers that belong to the branch around them; the others open one of their own.
INNER = frozenset("ul ol dl table thead tbody tr blockquote figure".split())


class Block:
    __slots__ = ("branch", "href", "linked", "no", "parts", "path", "plain", "tag")

    def __init__(self, no: int, tag: str, branch: tuple[int, int], path: int):
        self.no, self.tag, self.branch, self.path = no, tag, branch, path
        self.parts: list[str] = []
        self.linked = self.plain = 0
        self.href = ""


@lru_cache(20_000)  # the pages of a site open the same containers
def _path(path: int, name: str, attrs: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{path}/{name}" + "".join(f".{x or y or z}" for x, y, z in STYLE.findall(attrs)))


def read_blocks(html: str) -> list[Block]:
    """The numbered blocks of a page in order, each with the branch it belongs to and a hash of its container's path.

    A branch is a container's content up to the next heading below h1 in it (container number, heading number); a page that opens none has
    one a container.
    """
    text = SILENT.sub(" ", html)
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[int, int], int]] = []
    branch, path, containers = (0, 0), 0, 0
    headings: dict[int, int] = {}
    block: Block | None = None
    link = 0
    parts = TAG.split(text)
    for s, closing, name, attrs in zip(parts[::4], [*parts[1::4], ""], [*parts[2::4], ""], [*parts[3::4], ""]):  # a text and the tag behind it
        if s and block is not None and not s.isspace():
            block.parts.append(s)
            if link:
                block.linked += len(s)
            else:
                block.plain += len(s)
        name = name.lower()
        if closing:
            if name == "a":
                link = 0
            elif block is not None and name == block.tag:
                block = None
            elif name in CONTAINERS:
                block, link = None, 0
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        _, branch, path = stack[k]
                        branch = (branch[0], headings.get(branch[0], 0))
                        del stack[k:]
                        break
            continue
        n = NUMBER.search(attrs) if "data-n" in attrs else None
        if n:
            if name in HEADINGS and name != "h1":
                headings[branch[0]] = headings.get(branch[0], 0) + 1
                branch = (branch[0], headings[branch[0]])
            block, link = Block(int(n.group(1)), name, branch, path), 0
            blocks.append(block)
        elif name == "a":
            link = 1
            if block is not None and not block.href and (h := HREF.search(attrs)):
                block.href = h.group(1)
        elif name in CONTAINERS:
            block, link = None, 0
            stack.append((name, branch, path))
            if name not in INNER or not stack[:-1]:
                containers += 1
                branch = (containers, 0)
                path = _path(path, name, attrs)
    return blocks


def site_of(url: str | None) -> str:
    m = re.match(r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", url or "", re.I)
    return m.group(1).lower() if m else ""


def _hashed(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text) - (1 << 63)


@lru_cache(1_000)
def _label(host: str) -> str:
    label = max(re.sub(r"^www\.", "", host).split(".")[:-1], key=len, default="")
    return label if len(label) > 3 else ""


@lru_cache(50_000)  # furniture recurs on page after page
def _text_key(text: str, label: str) -> int:
    """A hash of the text without digits and the site's label."""
    if label and (label in text.lower() or not text.isascii() or not label.isascii()):
        text = re.sub(re.escape(label), "@", text, flags=re.I)
    masked = text.lower()
    if masked.count(" ") > 2:
        masked = DIGITS.sub("#", masked)
    # a path begins with a page that many paths begin with, and the menu names it too
    return _hashed(STEP.split(masked, maxsplit=1)[0])


@lru_cache(50_000)
def _place(href: str) -> int:
    return _hashed("@" + DIGITS.sub("#", href))


def features(html: str, host: str) -> list[tuple]:
    """(block_no, key, element, place, words, flags, container, heading, tag) of the blocks with text.

    key is a hash of the text without digits and site name, element one of the container's path, place what the block's link leads to, or the key.
    """
    label = _label(host)
    out = []
    for blk in read_blocks(html):
        text = " ".join("".join(blk.parts).split())
        if "&" in text:
            text = " ".join(unescape(text).split())
        if not text:
            continue
        flags = 0
        if blk.linked > blk.plain:
            flags |= ANCHORED
        if blk.tag in HEADINGS:
            flags |= TOP_HEADING if blk.tag == "h1" else HEADING
        key = _text_key(text, label)
        place = _place(blk.href) if flags & ANCHORED and blk.href else key
        out.append((blk.no, key, blk.path - (1 << 63), place, text.count(" ") + 1, flags, *blk.branch, blk.tag))
    return out


def elements_of(got: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(element, variant, blocks, words) of a page: how it fills each container."""
    from xxhash import xxh64_intdigest

    filled: dict[int, list] = {}
    for _, _, el, _, words, flags, _, _, tag in got:
        f = filled.setdefault(el, [[], 0, 0])
        if not f[0] or f[0][-1] != (tag, flags & ANCHORED):  # repeated blocks are one
            f[0].append((tag, flags & ANCHORED))
        f[1] += 1
        f[2] += words
    return [(el, xxh64_intdigest(repr(f[0])) - (1 << 63), f[1], f[2]) for el, f in filled.items()]


PARSED = (
    "page_id long, host string, nos array<long>, keys array<long>, elements array<long>, places array<long>, words array<int>, flags array<int>,"
    " containers array<int>, headings array<int>, styles array<struct<element:long,variant:long,blocks:long>>"
)


def parse(pages: DataFrame) -> DataFrame:
    """One row a page with text: its host and its blocks' features as arrays."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.int32()] * 4
        style = pa.list_(pa.struct([("element", pa.int64()), ("variant", pa.int64()), ("blocks", pa.int64())]))
        for batch in batches:
            ids, hosts, cols, styles = [], [], [[] for _ in kinds], []
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                host = site_of(url)
                got = features(html, host) if html else []
                if got:
                    ids.append(page)
                    hosts.append(host)
                    for c, v in zip(cols, zip(*got)):
                        c.append(list(v))
                    styles.append([{"element": e, "variant": v, "blocks": n} for e, v, n, _ in elements_of(got)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), *(pa.array(c, pa.list_(t)) for c, t in zip(cols, kinds)), pa.array(styles, style)],
                names=["page_id", "host", "nos", "keys", "elements", "places", "words", "flags", "containers", "headings", "styles"],
            )

    return pages.select("page_id", "source_url", "html").mapInArrow(run, PARSED)


def heading_links(parsed: DataFrame) -> DataFrame:
    """(key, n_links, n_blocks): what stands under a heading, merged over all pages that have it."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            total: dict[int, list[int]] = {}
            for keys, flags, containers, headings in zip(pdf["keys"], pdf["flags"], pdf["containers"], pdf["headings"]):
                heads = {}
                for k, f, b in zip(keys, flags, zip(containers, headings)):
                    if f & HEADING:
                        heads[b] = k
                        total.setdefault(k, [0, 0])
                    elif b in heads:
                        t = total[heads[b]]
                        t[0] += f & ANCHORED
                        t[1] += 1
            yield pd.DataFrame([(k, a, n) for k, (a, n) in total.items()], columns=["key", "a", "n"])

    rows = parsed.select("keys", "flags", "containers", "headings").mapInPandas(run, "key long, a long, n long")
    return rows.groupBy("key").agg(F.sum("a").alias("n_links"), F.sum("n").alias("n_blocks"))


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, element, pages, composite): the merged element nodes of each host with their importance."""
    filled = parsed.select("host", F.explode("styles").alias("s")).groupBy("host", "s.element", "s.variant").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s.blocks").alias("blocks")
    )
    log_m = F.log(F.greatest(F.col("pages"), F.lit(2)))
    nodes = (
        filled.groupBy("host", "element")
        .agg(F.sum("n").alias("pages"), F.sum("blocks").alias("blocks"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"))
        # -sum p log_m p, for p = n / pages
        .withColumn("presentation", F.when(F.col("pages") <= 1, 1.0).otherwise(F.log("pages") / log_m - F.col("n_log_n") / F.col("pages") / log_m))
    )
    stood = F.arrays_zip(F.col("elements").alias("element"), F.col("places").alias("place"), F.col("words").alias("words"))
    spread = parsed.select("host", F.explode(F.array_distinct(stood)).alias("s"))
    contents = spread.groupBy("host", "s.element", "s.place").agg(F.count(F.lit(1)).alias("n"), F.max("s.words").alias("words"))
    leaf = F.greatest(F.lit(0.0), 1 - F.log("n") / log_m)
    weighed = (
        contents.join(nodes.select("host", "element", "pages"), ["host", "element"])
        .groupBy("host", "element")
        .agg((F.sum(leaf * F.col("words") * F.col("n")) / F.sum(F.col("words") * F.col("n"))).alias("content"))
    )
    damped = F.pow(F.lit(DAMPING), F.col("blocks") / F.col("pages"))
    return nodes.join(weighed, ["host", "element"]).select(
        "host", "element", "pages", ((1 - damped) * F.col("presentation") + damped * F.col("content")).alias("composite"), "presentation", "content"
    )


@lru_cache(20_000)  # shares are quotients of counts of pages
def importance(share: float) -> float:
    """1 - H of a node on this share of the pages of a tree."""
    return min(1.0, -math.log(max(share, 1e-9)) / math.log(TREE_PAGES))


def keep_blocks(nos, keys, elements, words, flags, branches, tree: tuple, all_share: dict, heads: dict) -> list[int]:
    """Numbers of the blocks of the main body; tree is (pages of the host, key -> pages, element -> (pages, composite importance))."""
    host_pages, host_df, host_elements = tree
    leaf = [importance((max(0, host_df.get(k, 1) - 1) + PRIOR_PAGES * all_share.get(k, 0.0)) / (host_pages + PRIOR_PAGES)) for k in keys]
    stays = [i >= LEAF + (LONG_LEAF - LEAF) * (1 - 1 / w) for i, w in zip(leaf, words)]  # sentences repeat by chance less than cells do
    # a text that is a heading on other pages opens a branch too, whatever its element is here
    parts, opened, last = [], 0, None
    for k, f, b in zip(keys, flags, branches):
        if b != last:
            opened, last = 0, b
        if k in heads and not f & (HEADING | TOP_HEADING | ANCHORED):
            opened += 1
        parts.append((*b, opened))
    good: dict[tuple, float] = {}
    total: dict[tuple, float] = {}
    headed: dict[tuple, int] = {}
    element: dict[tuple, int] = {}
    own: dict[int, list[float]] = {}
    titled = set()
    for k, el, w, f, b, i, stay in zip(keys, elements, words, flags, parts, leaf, stays):
        good.setdefault(b, 0.0)
        total.setdefault(b, 0.0)
        element[b] = el
        if f & TOP_HEADING:
            titled.add(b)
        elif f & HEADING or (k in heads and b[2]):
            headed[b] = k
        else:
            plain = 0.0 if f & ANCHORED or not stay else w * i
            if stay:
                total[b] += w
                good[b] += plain
            mine = own.setdefault(el, [0.0, 0.0])
            mine[0] += plain
            mine[1] += w
    node = {}
    for el, (g, t) in own.items():  # the merged element, or the page itself where the host has few pages with it
        m, composite = host_elements.get(el, (0, 0.0))
        node[el] = (m * composite + PRIOR_PAGES * (g / t if t else 0.0)) / (m + PRIOR_PAGES)
    kept = {}
    for b, t in total.items():
        whole = node.get(element[b], 0.0)
        if b in headed:
            prior = 1 - heads[headed[b]] if headed[b] in heads else whole
            share = (good[b] + PRIOR_WORDS * prior) / (t + PRIOR_WORDS)
            # under a heading that lists other pages everywhere, longer texts are promotions
            kept[b] = whole >= ELEMENT and (share if prior >= 0.5 else min(share, prior)) >= BRANCH
        else:
            kept[b] = b in titled or bool(t) and whole >= ELEMENT and (good[b] + PRIOR_WORDS * whole) / (t + PRIOR_WORDS) >= ELEMENT
    for b in total:  # a list of links at the head of a container goes with the container's first branch
        if b[1:] == (0, 0) and not kept[b] and total[b] and kept.get((b[0], 1, 0)):
            kept[b] = True
    out = []
    for no, k, f, b, stay in zip(nos, keys, flags, parts, stays):
        if kept[b] and (f & (TOP_HEADING | HEADING) or stay or (k in heads and heads[k] < 0.5)):
            out.append(no)
    return out


def main_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no) of the blocks of the main body of each page."""
    parsed = cut(parse(pages))
    n_pages = max(1, parsed.count())
    spread = parsed.select("host", F.explode(F.array_distinct("keys")).alias("key"))
    by_host = cut(spread.groupBy("host", "key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    common = (
        by_host.groupBy("key").agg(F.sum("df").alias("df")).filter(F.col("df") >= max(3, GLOBAL_SHARE * n_pages)).collect()
    )  # at most blocks of a page / GLOBAL_SHARE rows
    all_share = {r.key: (r.df - 1) / n_pages for r in common}
    heads_df = heading_links(parsed).filter(F.col("n_blocks") >= max(3, GLOBAL_SHARE * n_pages)).collect()
    heads = {r.key: r.n_links / r.n_blocks for r in heads_df}
    told = pages.sparkSession.sparkContext.broadcast((all_share, heads))

    sizes = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    # a node counts for a host only from a share on, so the arrays are bounded by the nodes of a page over that share
    shared = lambda n: F.col(n) * 25 >= F.col("host_pages")
    leaves = by_host.join(sizes, "host").filter(shared("df")).groupBy("host").agg(F.collect_list(F.struct("key", "df")).alias("leaves"))
    elements = (
        style_tree(parsed).join(sizes, "host").filter(shared("pages"))
        .groupBy("host").agg(F.collect_list(F.struct("element", "pages", "composite")).alias("nodes"))
    )
    trees = cut(sizes.join(leaves, "host", "left").join(elements, "host", "left"))
    joined = join_unique(parsed.drop("places", "styles"), trees, "host")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shares, headings = told.value
        seen: dict[str, tuple] = {}
        for batch in batches:
            table = pa.table(batch)
            columns = {c: table.column(c) for c in table.column_names}
            hosts = columns["host"].to_pylist()
            rows = zip(*(columns[c].to_pylist() for c in ("page_id", "nos", "keys", "elements", "words", "flags", "containers", "headings")))
            pages_, blocks = [], []
            for n, (page, nos, keys, els, words, flags, containers, heads_) in enumerate(rows):
                host = hosts[n]
                if host not in seen:
                    if len(seen) > 500:
                        seen.clear()
                    leaves_, nodes_ = columns["leaves"][n].as_py(), columns["nodes"][n].as_py()
                    seen[host] = (
                        columns["host_pages"][n].as_py() or 1,
                        {x["key"]: x["df"] for x in leaves_ or ()},
                        {x["element"]: (x["pages"], x["composite"]) for x in nodes_ or ()},
                    )
                got = keep_blocks(nos, keys, els, words, flags, list(zip(containers, heads_)), seen[host], shares, headings)
                pages_.extend([page] * len(got))
                blocks.extend(got)
            yield pa.RecordBatch.from_arrays([pa.array(pages_, pa.int64()), pa.array(blocks, pa.int64())], names=["page_id", "block_no"])

    return joined.mapInArrow(run, "page_id long, block_no long").distinct()


def main_text(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, main_text): the text of the given blocks of each page, a block a line. Pages without blocks are left out."""
    wanted = blocks.groupBy("page_id").agg(F.collect_set("block_no").alias("_nos"))  # bounded by the blocks of a page

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, htmls, nos = (batch.column(i).to_pylist() for i in range(3))
            texts = []
            for html, keep in zip(htmls, nos):
                keep = set(keep)
                lines = (" ".join(unescape("".join(b.parts)).split()) for b in read_blocks(html) if b.no in keep)
                texts.append("\n".join(t for t in lines if t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["page_id", "main_text"])

    joined = pages.select("page_id", "html").join(wanted, "page_id")
    return joined.select("page_id", "html", "_nos").mapInArrow(run, "page_id long, main_text string")
