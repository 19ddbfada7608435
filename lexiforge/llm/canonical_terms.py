"""Mapping free-entered values to a canonical list.

A multi-pattern automaton over the canonical names and their short writings, both squeezed to letters and
digits, finds embedded mentions; of overlapping mentions the longest wins. Values without a mention go to a
token-set similarity whose tokens may be misspelt (a few edits, and at most ``DELETIONS`` letters of either without a counterpart), cut short or
in another order. The reference list is a
reference table with a contract bound (``MAX_TERMS``); the values are never shuffled: each Arrow batch is mapped
in place, distinct values once, so one value that holds a third of all rows costs one look-up a batch.

Null values are no cases. Empty and punctuation-only values name nothing (-1). Ties between two entries name
nothing (-1). An empty list gives -1 for every value; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.runtime import bounded_rows

MAX_TERMS = 50_000  # of the reference list; its index takes some 8 KB an entry
MAX_CACHED = 200_000
MOST_EDITS = 3
DELETIONS = 2  # letters of either word that may be without a counterpart in the other; as many are indexed, so no entry is missed
MIN_SCORE = 0.66
MIN_LEAD = 0.04
#: Digits and letter pairs that are read as letters.
READ_AS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "rn": "m", "vv": "w"}
#: Words around a name that don't change what it names.
AROUND = frozenset(
    "the by from a an of and our brand brands category shop store official inc ltd llc gmbh co corp company accessories"
    " product products range buy all new cat type".split()
)


def fold(value: str) -> list[str]:
    """Lower-case tokens of letters and digits without accents."""
    text = unicodedata.normalize("NFKD", value)
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.findall(r"[^\W_]+", text.casefold())


def letter_masks(word: str) -> dict[str, int]:
    """letter -> its places in the word as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def edits(a: str, b: str, limit: int, masks: dict[str, int] | None = None) -> int:
    """Optimal string alignment distance, or limit + 1 if it is larger; bit-parallel over the letters of ``b``."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if not b:
        return min(len(a), limit + 1)
    masks = letter_masks(b) if masks is None else masks
    full, last = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, diagonal, before, distance = full, 0, 0, 0, len(b)  # vertical steps of +1 and -1, and zero diagonal steps
    for c in a:
        here = masks.get(c, 0)
        swapped = ((~diagonal & here) << 1) & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swapped) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up  # horizontal steps
        distance += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down, before = (left | ~(diagonal | right)) & full, right & diagonal, here
    return min(distance, limit + 1)


def _deletes(word: str, n: int) -> set[str]:
    out, layer = {word}, {word}
    for _ in range(n):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def allowed_edits(length: int) -> int:
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 9 else MOST_EDITS


class NearIndex:
    """Words by the hashes of what is left of them after some deletions, in sorted arrays."""

    def __init__(self, words: list[str]):
        import numpy as np

        self.words = words
        hashes, owner = [], []
        for k, w in enumerate(words):
            few = _deletes(w, min(DELETIONS, allowed_edits(len(w))))
            hashes.extend(map(hash, few))
            owner.extend([k] * len(few))
        order = np.argsort(np.array(hashes, dtype=np.int64), kind="stable")
        self.hashes, self.owner = np.array(hashes, dtype=np.int64)[order], np.array(owner, dtype=np.int64)[order]

    def near(self, word: str) -> list[str]:
        """The words that are equal to this one but for ``DELETIONS`` letters of each, and some others."""
        import numpy as np

        few = _deletes(word, min(DELETIONS, allowed_edits(len(word) + DELETIONS)))
        wanted = np.fromiter(map(hash, few), dtype=np.int64, count=len(few))
        first, last = np.searchsorted(self.hashes, wanted, "left"), np.searchsorted(self.hashes, wanted, "right")
        hit = np.flatnonzero(last > first)
        return [self.words[k] for k in {k for h in hit for k in self.owner[first[h] : last[h]].tolist()}]


class TermMatcher:
    """Looks values up in a list of (term_id, kind, name, short writings)."""

    def __init__(self, terms: list[tuple]):
        import ahocorasick

        self.terms = {t[0]: (t[1], fold(t[2])) for t in terms}
        self.names = {(t[1], t[2]): t[0] for t in terms}
        writings: dict[str, set[int]] = {}
        for tid, _, name, shorts in terms:
            for w in [name, *(shorts or [])]:
                if key := "".join(fold(w)):
                    writings.setdefault(key, set()).add(tid)
        self.writings = writings
        self.automaton = ahocorasick.Automaton()
        for key in writings:
            self.automaton.add_word(key, key)
        if writings:
            self.automaton.make_automaton()
        self.by_token: dict[str, set[int]] = {}
        for tid, (_, tokens) in self.terms.items():
            for t in tokens:
                self.by_token.setdefault(t, set()).add(tid)
        self.near_token = NearIndex(list(self.by_token))
        self.prefixes: dict[str, set[str]] = {}
        for t in self.by_token:
            for n in range(3, len(t)):
                self.prefixes.setdefault(t[:n], set()).add(t)
        self.by_whole: dict[str, set[int]] = {}
        for tid, (_, tokens) in self.terms.items():
            self.by_whole.setdefault("".join(tokens), set()).add(tid)
        self.near_whole = NearIndex(list(self.by_whole))
        targets = self.by_token.keys() | self.by_whole.keys()
        self.masks = {t: letter_masks(t) for t in targets}
        self.longest = max(map(len, targets), default=0)
        self.cache: dict[tuple, int] = {}
        self.token_cache: dict[str, list] = {}

    def lookup(self, value: str, kinds: tuple[str, ...]) -> int:
        key = (value, kinds)
        if key not in self.cache:
            if len(self.cache) >= MAX_CACHED:
                self.cache.clear()
            self.cache[key] = self._find(value, kinds)
        return self.cache[key]

    def _find(self, value: str, kinds: tuple[str, ...]) -> int:
        tokens = fold(value)
        if not tokens or not self.terms:
            return -1
        found = self._mentions(tokens)
        if found:
            named = {t for m in found for t in m if self.terms[t][0] in kinds}
            return named.pop() if len(named) == 1 and all(any(self.terms[t][0] in kinds for t in m) for m in found) else -1
        core = [t for t in tokens if t not in AROUND] or tokens
        return self._similar(core, kinds)

    def _mentions(self, tokens: list[str]) -> list[set[int]]:
        """Longest mentions that don't overlap and begin and end with a token."""
        text = "".join(tokens)
        starts, ends, at = set(), set(), 0
        for t in tokens:
            starts.add(at)
            at += len(t)
            ends.add(at)
        spans = [(e + 1 - len(w), e + 1, w) for e, w in self.automaton.iter(text)]
        spans = [s for s in spans if s[0] in starts and s[1] in ends]
        out, taken = [], []
        for b, e, w in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            if all(e <= x or b >= y for x, y in taken):
                taken.append((b, e))
                out.append(self.writings[w])
        # a one-token short writing amid other words is a mention only if those words carry no name of their own
        rest = sum(len(t) for t in tokens if t not in AROUND) - sum(e - b for b, e in taken)
        if out and rest > 0 and all(e - b <= 4 for b, e in taken):
            return []
        return out

    def _token_matches(self, token: str) -> list[tuple[str, float]]:
        """Canonical tokens that this token may stand for, with a similarity."""
        if token in self.token_cache:
            return self.token_cache[token]
        found: dict[str, float] = {}
        if token in self.by_token:
            found[token] = 1.0
        for t in self.prefixes.get(token, ()):
            found[t] = max(found.get(t, 0), 0.9)
        if len(token) > 2 * self.longest + DELETIONS:  # letter pairs read as one at most halve it
            return []
        forms = {token}
        for a, b in READ_AS.items():
            forms |= {f.replace(a, b) for f in forms if a in f}
        if "1" in token:
            forms |= {f.replace("l", "i") for f in forms}
        for form in forms:
            limit = allowed_edits(len(form))
            for t in self.near_token.near(form):
                n = edits(form, t, limit, self.masks[t])
                if n <= min(limit, allowed_edits(len(t))):
                    found[t] = max(found.get(t, 0), 1 - n / max(len(t), len(form)))
        if len(self.token_cache) >= MAX_CACHED:
            self.token_cache.clear()
        self.token_cache[token] = out = list(found.items())
        return out

    def _similar(self, core: list[str], kinds: tuple[str, ...]) -> int:
        size = sum(map(len, core))
        if size > (self.longest + DELETIONS) * (2 / MIN_SCORE):
            return -1  # the words besides weigh too much for any entry to reach MIN_SCORE
        options = [dict(self._token_matches(t)) for t in core]
        scores: dict[int, float] = {}
        for tid in {i for o in options for t in o for i in self.by_token[t]}:
            kind, tokens = self.terms[tid]
            if kind not in kinds:
                continue
            gained, left = 0.0, set(range(len(core)))
            for t in tokens:
                k = max(left, key=lambda k: options[k].get(t, 0), default=None)
                if k is None or not options[k].get(t):
                    gained = 0
                    break
                gained += options[k][t] * (len(t) + len(t) * (len(core[k]) / len(t) if options[k][t] == 0.9 else 1))
                left.discard(k)
                if options[k][t] == 0.9:  # a cut-short token is as good as the whole one
                    gained += 0.9 * (len(t) - len(core[k]))
            if gained:
                weight = sum(len(t) for t in tokens)
                extra = sum(len(core[k]) for k in left)
                scores[tid] = gained / (2 * weight + extra)
        whole = "".join(core)
        forms = {whole}
        for a, b in READ_AS.items():
            forms |= {f.replace(a, b) for f in forms if a in f}
        if size >= 5:
            for form in forms:
                if len(form) > self.longest + DELETIONS:
                    continue  # too long for every entry
                for target in self.near_whole.near(form):
                    limit = allowed_edits(len(target))
                    n = edits(form, target, limit, self.masks[target])
                    if n <= limit:
                        for tid in self.by_whole[target]:
                            if self.terms[tid][0] in kinds:
                                scores[tid] = max(scores.get(tid, 0), 1 - n / len(target))
        if not scores:
            return -1
        best = sorted(scores.items(), key=lambda x: -x[1])
        if best[0][1] < MIN_SCORE or len(best) > 1 and best[0][1] - best[1][1] < MIN_LEAD:
            return -1
        return best[0][0]


def term_rows(terms: DataFrame) -> list[tuple]:
    """The list on the driver. It is a reference list that people keep: more than ``MAX_TERMS`` entries are an error, never cut."""
    got = bounded_rows(terms.select("term_id", "kind", "term_name", "short_forms"), MAX_TERMS, "the canonical list")
    return [(r.term_id, r.kind, r.term_name, list(r.short_forms or [])) for r in got if r.term_name]


FIELD_KINDS = {"brand": ("brand",), "category": ("category",), "alias": ("brand", "category")}
_MATCHER: dict = {}


def matcher_of(key: str, told) -> TermMatcher:
    """The matcher of a broadcast list, made once a worker."""
    if key not in _MATCHER:
        _MATCHER.clear()
        _MATCHER[key] = TermMatcher(told.value)
    return _MATCHER[key]


def map_values(cases: DataFrame, terms: DataFrame, field_kinds: dict = FIELD_KINDS) -> DataFrame:
    """(field, record_id, value) -> (field, record_id, value, term_id); term_id is -1 for values that name no entry."""
    told = cases.sparkSession.sparkContext.broadcast(term_rows(terms))  # at most MAX_TERMS rows
    key = uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        matcher = matcher_of(key, told)
        for pdf in batches:
            pairs = list(zip(pdf["field"], pdf["value"]))
            known = {p: matcher.lookup(p[1], field_kinds[p[0]]) for p in set(pairs)}
            pdf["term_id"] = [known[p] for p in pairs]
            yield pdf[["field", "record_id", "value", "term_id"]]

    return cases.select("field", "record_id", "value").mapInPandas(
        run, "field string, record_id long, value string, term_id long"
    )


def free_values(context: DataFrame, aliases: DataFrame, terms: DataFrame) -> DataFrame:
    """The non-null values that aren't, character by character, the name of an entry allowed for their field."""
    names = terms.filter("term_name is not null").select("kind", F.col("term_name").alias("value")).distinct()
    if names.count() > MAX_TERMS:
        raise ValueError(f"the canonical list has more than {MAX_TERMS} entries; it is meant to be a small reference table")

    def of(df: DataFrame, field: str, rid: str, column: str) -> DataFrame:
        exact = names.filter(F.col("kind").isin(*FIELD_KINDS[field])).select("value").distinct()
        told = df.filter(F.col(column).isNotNull()).select(F.lit(field).alias("field"), F.col(rid).alias("record_id"), F.col(column).alias("value"))
        return told.join(F.broadcast(exact), "value", "left_anti").select("field", "record_id", "value")  # of checked size

    return (
        of(context, "brand", "context_id", "brand")
        .unionByName(of(context, "category", "context_id", "category"))
        .unionByName(of(aliases, "alias", "alias_id", "base"))
    )


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """Values that name no entry, with how often they occur in each field."""
    return mapped.filter("term_id = -1").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
