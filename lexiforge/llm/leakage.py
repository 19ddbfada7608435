"""Evaluation texts leaking into training text, found by latent semantic retrieval.

Passages are windows of ``RUN`` words, of the items one at each word:
1. document frequencies of hashed words over all documents (map-side reduced to one vector a partition);
2. a distributed randomised SVD of TF-IDF passages: of the items, and of the corpus a documented, bounded sample
   (``FIT_DOCUMENTS``, ``FIT_PASSAGES``); the partial products are summed block by block on the executors;
3. windows of every document whose weight lies on words of one item are projected into the latent space and compared, by the
   cosine there, with the passages of just those items. A window all of whose words stand in an item is always compared, and equal
   passages have cosine 1 in any latent space: a run of ``RUN`` common words is found whatever the rank and the sample;
4. candidates are checked on the words themselves: the longest run of consecutive common words, and for paraphrases the longest
   common subsequence with the item's passage and whether the item's answer stands in the document.

Items are worked off in blocks of bounded size (``MAX_ITEMS`` items, ``MAX_ITEM_CHARS`` characters), so what is broadcast stays bounded and any number of
items can be searched for; the matrices have a fixed size. Documents are never shuffled whole; hot sources, copies or keys don't
matter, as a document is worked off where it is, whole and at any length. Null and empty texts match nothing; items shorter than the run
give no run; repeated items are reported each.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.runtime import cut

DIMS = 1 << 14  # hashed words
RANK = 128
RUN = 12  # words of a passage
FIT_STEP = 6  # words between the passages of the fit
COSINE = 0.98  # of a passage taken over word by word; such ones have 1
PARAPHRASE_STEP = 4  # words between windows
PARAPHRASE_WORDS, PARAPHRASE_SHARE = 7, 0.6  # of a window that stand in the item, and their least share of its weight
PARAPHRASE_COSINE, PARAPHRASE_LCS = 0.7, 0.7
MARGIN = 6  # words around a passage that the subsequence may use
MAX_ITEMS, MAX_ITEM_CHARS = 10_000, 8_000_000  # of a block of items
FIT_DOCUMENTS, FIT_PASSAGES = 600, 12_000  # of the corpus, chosen by hash
CORPUS_WEIGHT = 0.1
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class Hasher(dict):
    """word -> dimension, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = d = zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMS
        return d


def window_starts(n: int) -> list[int]:
    """Starts of the passages of the fit that cover n words; the last one ends with the text."""
    if n <= RUN:
        return [0] if n else []
    starts = list(range(0, n - RUN + 1, FIT_STEP))
    if starts[-1] != n - RUN:
        starts.append(n - RUN)
    return starts


def inverse_frequencies(documents: DataFrame):
    """idf of each hashed word over all documents."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import pandas as pd

        seen, n, h = np.zeros(DIMS, dtype=np.int64), 0, Hasher()
        for pdf in batches:
            for text in pdf["text"]:
                ids = [h[w] for w in set(words_of(text))]
                seen[list(set(ids))] += 1
                n += 1
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"dim": np.append(used, -1), "n": np.append(seen[used], n)})

    rows = documents.select("text").mapInPandas(count, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(DIMS), 0
    for r in rows:  # at most DIMS + 1
        if r.dim < 0:
            total = r.n
        else:
            df[r.dim] = r.n
    return np.log((total + 1.0) / (df + 1.0)).astype(np.float32) + 0.1


def _passage_vectors(texts, idf, h: Hasher):
    """Unit TF-IDF vectors of the windows of each text: lists of (text no, start, dims, weights)."""
    import numpy as np

    for k, text in enumerate(texts):
        ids = np.array([h[w] for w in words_of(text)], dtype=np.int64)
        for s in window_starts(len(ids)):
            dims, counts = np.unique(ids[s : s + RUN], return_counts=True)
            weights = counts * idf[dims]
            yield k, s, dims, (weights / np.linalg.norm(weights)).astype(np.float32)


def latent_basis(items: list, sample: DataFrame, idf, rank: int = RANK, seed: int = 5):
    """(DIMS x rank) orthonormal basis of the leading right singular space of the TF-IDF passages.

    Randomised subspace iteration: each partition multiplies its own passages, and the products are summed over
    partitions in blocks of dimensions, so no task holds more than one product and one block of all.
    """
    import numpy as np

    spark = sample.sparkSession
    texts = spark.createDataFrame([(t,) for t in items], "text string").repartition(4)
    corpus = sample.select("text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS)

    def scaled(scale: float):
        def vectors(batches: Iterator) -> Iterator:
            import pandas as pd

            h = Hasher()
            for pdf in batches:
                rows = [(d.tolist(), (w * scale).tolist()) for _, _, d, w in _passage_vectors(pdf["text"], idf, h)]
                yield pd.DataFrame(rows, columns=["dims", "weights"])

        return vectors

    # the sample weighs CORPUS_WEIGHT of the items, else the corpus' own topics would crowd out the space to search in
    n_items = sum(len(window_starts(len(words_of(t)))) for t in items)
    schema = "dims array<int>, weights array<float>"
    all_corpus = corpus.mapInPandas(scaled(float(np.sqrt(CORPUS_WEIGHT * n_items / FIT_PASSAGES))), schema)
    few = (
        all_corpus.withColumn("_h", F.xxhash64("dims", "weights")).orderBy("_h").limit(FIT_PASSAGES).drop("_h")
    )  # a top-k by hash: the sample is uniform and the same on every run
    passages = cut(texts.mapInPandas(scaled(1.0), schema).unionByName(few).repartition(6))
    block = DIMS // 16

    def product(basis):
        """sum over partitions of A' (A basis)."""
        told = spark.sparkContext.broadcast(basis)

        def part(batches: Iterator) -> Iterator:
            import pandas as pd

            q = told.value
            acc = np.zeros_like(q)
            for pdf in batches:
                for d, w in zip(pdf["dims"], pdf["weights"]):
                    d = np.asarray(d)
                    acc[d] += np.outer(w, np.asarray(w) @ q[d])
            yield pd.DataFrame({"block": range(16), "m": [acc[b * block : (b + 1) * block].tobytes() for b in range(16)]})

        def add(pdf):
            import pandas as pd

            total = sum(np.frombuffer(m, dtype=np.float32) for m in pdf["m"])
            return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "m": [total.astype(np.float32).tobytes()]})

        rows = passages.mapInPandas(part, "block int, m binary").groupBy("block").applyInPandas(add, "block int, m binary").collect()
        out = np.zeros_like(basis)
        for r in rows:  # 16 blocks of a fixed size
            out[r.block * block : (r.block + 1) * block] = np.frombuffer(r.m, dtype=np.float32).reshape(block, -1)
        told.unpersist()
        return out

    q = np.random.default_rng(seed).standard_normal((DIMS, rank)).astype(np.float32)
    for _ in range(3):
        q = np.linalg.qr(product(q))[0].astype(np.float32)
    return q


class ItemIndex:
    """Words, answers and passages of a block of items; vectors of passages are made when first asked for."""

    def __init__(self, items: list[tuple], idf, basis):
        import numpy as np

        self.idf, self.basis, self.hasher = idf, basis, Hasher()
        self.ids = [i for i, _, _ in items]
        self.words = [words_of(t) for _, t, _ in items]
        self.answers = [" ".join(words_of(a)) for _, _, a in items]
        self.vocabulary: dict[str, int] = {}
        holders: list[list[int]] = []
        for k, ws in enumerate(self.words):
            for w in set(ws):
                v = self.vocabulary.setdefault(w, len(holders))
                if v == len(holders):
                    holders.append([])
                holders[v].append(k)
        self.masks = [sum(1 << k for k in ks) for ks in holders]  # the items of each word as a set of bits
        self.first = np.cumsum([0, *map(len, holders)])  # and as slices of one array
        self.holders = np.array([k for ks in holders for k in ks], dtype=np.int64)
        self._vectors: dict[int, object] = {}

    def project(self, dims, starts, length: int):
        """Unit latent vectors of the windows of ``length`` words at ``starts``."""
        import numpy as np

        at = np.asarray(starts)[:, None] + np.arange(length)
        own = dims[at]
        x = np.matmul(self.idf[own][:, None, :], self.basis[own])[:, 0]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def passages(self, k: int):
        """Latent vectors of all passages of item k."""
        import numpy as np

        if k not in self._vectors:
            if len(self._vectors) >= 2_000:
                self._vectors.clear()
            dims = np.array([self.hasher[w] for w in self.words[k]], dtype=np.int64)
            length = min(RUN, len(dims))
            self._vectors[k] = self.project(dims, range(len(dims) - length + 1), length)
        return self._vectors[k]


def longest_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of consecutive common words."""
    best, last = 0, {}
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    for w in a:
        row = {}
        for j in where.get(w, ()):
            row[j] = n = last.get(j - 1, 0) + 1
            best = max(best, n)
        last = row
    return best


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words, bit-parallel."""
    full = (1 << len(b)) - 1
    masks: dict[str, int] = {}
    for j, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << j
    v = full
    for w in a:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def candidate_windows(ws: list[str], index: ItemIndex) -> dict[int, list[int]]:
    """item number -> starts of the windows that may hold a passage of it.

    A window is a candidate for each item that has all of its words (at any start), and for each item that has at least
    ``PARAPHRASE_WORDS`` of its words with ``PARAPHRASE_SHARE`` of its weight (at every ``PARAPHRASE_STEP``-th start).
    """
    import numpy as np

    n, get = len(ws), index.vocabulary.get
    ids = np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=n)
    sums = np.concatenate([[0], np.cumsum(ids >= 0)])
    known = sums[RUN:] - sums[:-RUN] if n >= RUN else np.empty(0)
    out: dict[int, list[int]] = {}
    for s in np.flatnonzero(known == RUN).tolist():
        both = -1
        for v in ids[s : s + RUN].tolist():
            both &= index.masks[v]
            if not both:
                break
        while both:
            low = both & -both
            out.setdefault(low.bit_length() - 1, []).append(s)
            both ^= low
    starts = np.flatnonzero(known >= PARAPHRASE_WORDS)
    starts = starts[starts % PARAPHRASE_STEP == 0]
    if not len(starts):
        return out
    energy = index.idf[[index.hasher[w] for w in ws]].astype(np.float64) ** 2
    sums = np.concatenate([[0.0], np.cumsum(energy)])
    n_items = len(index.words)
    step = max(1, 2_000_000 // n_items)
    for at in range(0, len(starts), step):  # windows by items, in blocks of bounded size
        few = starts[at : at + step]
        window, place = np.repeat(np.arange(len(few)), RUN), (few[:, None] + np.arange(RUN)).ravel()
        window, place = window[ids[place] >= 0], place[ids[place] >= 0]
        first, last = index.first[ids[place]], index.first[ids[place] + 1]
        many = last - first
        ends = np.cumsum(many)
        item = index.holders[np.repeat(first - ends + many, many) + np.arange(ends[-1])]
        pair = np.repeat(window, many) * n_items + item
        words = np.bincount(pair, minlength=len(few) * n_items)
        weight = np.bincount(pair, weights=np.repeat(energy[place], many), minlength=len(few) * n_items)
        least = np.repeat(PARAPHRASE_SHARE * (sums[few + RUN] - sums[few]), n_items)
        for x in np.flatnonzero((words >= PARAPHRASE_WORDS) & (weight >= least)).tolist():
            out.setdefault(x % n_items, []).append(int(few[x // n_items]))
    return out


def search_words(ws: list[str], index: ItemIndex, cosine: float = COSINE) -> dict[int, list]:
    """item number -> [best cosine, longest run, best share of the subsequence, answer in the document] of one document."""
    import numpy as np

    found: dict[int, list] = {}
    candidates, text = candidate_windows(ws, index), None
    if not candidates:
        return found
    dims = np.array([index.hasher[w] for w in ws], dtype=np.int64)
    places = np.unique(np.concatenate(list(candidates.values())))
    at_once = len(places) <= 4_096  # else item by item, so that a document of any length takes a bounded matrix
    vectors = index.project(dims, places, RUN) if at_once else None
    for k, starts in candidates.items():
        item, starts = index.words[k], np.unique(starts)
        if len(item) < RUN:
            continue
        best, run, share, regions = 0.0, 0, 0.0, []
        for at in range(0, len(starts), 4_096):
            few = starts[at : at + 4_096]
            own = vectors[np.searchsorted(places, few)] if at_once else index.project(dims, few, RUN)
            cos = own @ index.passages(k).T
            top = cos.max(axis=1)
            high = float(top.max())
            if high < PARAPHRASE_COSINE:
                continue
            best = max(best, high)
            for i in np.flatnonzero(top >= PARAPHRASE_COSINE).tolist():
                s = int(few[i])
                if top[i] >= cosine:  # windows that overlap make one region
                    if regions and s <= regions[-1][1]:
                        regions[-1][1] = s + RUN
                    else:
                        regions.append([s, s + RUN])
                if share < 1:
                    p = int(cos[i].argmax())
                    passage = item[max(0, p - MARGIN) : p + RUN + MARGIN]
                    around = ws[max(0, s - 2 * MARGIN) : s + RUN + 2 * MARGIN]
                    share = max(share, common_subsequence(around, passage) / len(passage))
        for b, e in regions:  # each run of RUN words is a window of its own, so a region holds the whole of a longer one
            run = max(run, longest_run(ws[b:e], item))
        if best >= PARAPHRASE_COSINE:
            if text is None:
                text = f" {' '.join(ws)} "
            answer = bool(index.answers[k]) and f" {index.answers[k]} " in text
            found[k] = [min(1.0, best), run, share, answer]
    return found


_INDEX: dict = {}


def index_of(key: str, told) -> ItemIndex:
    """The index of a broadcast block, made once a worker."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = ItemIndex(*told.value)
    return _INDEX[key]


def item_blocks(items: DataFrame, max_items: int = MAX_ITEMS, max_chars: int = MAX_ITEM_CHARS) -> list[DataFrame]:
    """The items with text, dealt to blocks of about the bounded size by hash."""
    told = items.select("item_id", "text", "answer").filter(F.length("text") > 0)
    n, chars = told.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n:
        return []
    blocks = max(-(-n // max_items), -(-chars // max_chars))
    if blocks == 1:
        return [told]
    return [told.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def search(documents: DataFrame, items: DataFrame, cosine: float = COSINE, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, cosine, longest_run, lcs_share, has_answer) of the candidates that pass a check.

    A candidate passes with a run of ``RUN`` common words, or as a paraphrase: a high cosine, a long common subsequence and
    the answer in the document.
    """
    schema = "doc_id long, item_id long, cosine double, longest_run int, lcs_share double, has_answer boolean"
    spark = documents.sparkSession
    out, idf = None, None
    blocks = item_blocks(items, max_items)
    for block in blocks:
        rows = [(r.item_id, r.text, r.answer) for r in block.collect()]  # of bounded size
        if not rows:
            continue
        idf = inverse_frequencies(documents) if idf is None else idf
        found = _search_block(documents, rows, idf, cosine, schema)
        if len(blocks) > 1:
            found = cut(found)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _search_block(documents: DataFrame, rows: list[tuple], idf, cosine: float, schema: str) -> DataFrame:
    basis = latent_basis([t for _, t, _ in rows], documents, idf)
    told = documents.sparkSession.sparkContext.broadcast((rows, idf, basis))
    key = uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        index = index_of(key, told)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ws = words_of(text)
                if len(ws) < RUN or index.vocabulary.keys().isdisjoint(ws):
                    continue
                for item, (c, r, lcs, ans) in search_words(ws, index, cosine).items():
                    if r >= RUN or (c >= PARAPHRASE_COSINE and lcs >= PARAPHRASE_LCS and ans):
                        out.append((doc, index.ids[item], c, r, lcs, ans))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "longest_run", "lcs_share", "has_answer"])

    return documents.select("doc_id", "text").mapInPandas(run, schema)


def leaked_runs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold ``RUN`` consecutive words of an item or more."""
    return search(documents, items).filter(F.col("longest_run") >= RUN).select("doc_id", "item_id").distinct()
