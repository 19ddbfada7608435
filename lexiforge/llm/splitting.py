"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text is first cut into atoms: paragraphs, lines, sentences, clauses or words, whichever is the coarsest that fits,
down to characters for a word that is too long itself. Adjacent atoms are held as pairs in a heap by the strength of
the boundary between them; the pair at the weakest boundary is merged first, as long as the merged piece and the
overlap fit into the limit. Each piece but the first then begins with the last ``overlap`` tokens of the text before it, over
as many pieces as they take. Where joining the two parts costs more tokens than both have, the overlap gives way by as little as keeps the limit,
and every piece reports its own in ``overlap_tokens``. An overlap begins at the nearest earlier word, if that fits.

Every text is worked off whole inside its Arrow batch; there is no shuffle. Texts within the limit are not split. Null and empty
texts, null limits and sources without a limit give no pieces; a null overlap is none. An overlap must leave room for new text: it is at most
the limit less a tenth of it (at least one token).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.tokens import TOKENIZER, encoding

#: Boundaries from strong to weak: between paragraphs, lines, sentences, clauses, words.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (r"\n[ \t]*\n\s*", r"\n\s*", r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])\s*", r"(?<=[,;:—])\s+|(?<=[、，；：])", r"\s+")
)
WORD = len(BOUNDARIES)
SLACK = 8  # tokens that may arise anew at the two ends of a piece


def atoms(text: str, size, most: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, tokens, strength of the boundary before): consecutive, covering the text, each of at most ``most`` tokens.

    Each level of boundaries is tried only on the parts that are still too large.
    """
    out: list[tuple[int, int, int, int]] = []

    def cut(begin: int, end: int, level: int, strength: int) -> None:
        n = size(text[begin:end])
        if n <= most and level > 0:
            out.append((begin, end, n, strength))
            return
        if level == WORD:  # a single word: halves, until they fit
            if n <= most or end - begin <= 1:
                out.append((begin, end, n, strength))
                return
            mid = (begin + end) // 2
            cut(begin, mid, level, strength)
            cut(mid, end, level, WORD)
            return
        at, first = begin, strength
        for m in BOUNDARIES[level].finditer(text, begin, end):
            if at < m.end() < end:
                cut(at, m.end(), level + 1, first)
                at, first = m.end(), level
        cut(at, end, level + 1, first)

    cut(0, len(text), 0, 0)
    return out


def merge(parts: list[tuple[int, int, int, int]], room: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces: merges the weakest boundaries first while tokens and overlap fit into ``room``."""
    n = len(parts)
    begin, end = [p[0] for p in parts], [p[1] for p in parts]
    tokens, strength = [p[2] for p in parts], [p[3] for p in parts]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive, version, stamp = [True] * n, list(range(n)), n  # a version is never used twice
    # weakest boundary first; among equals the pair of the smallest sum, then the earliest
    heap = [(-strength[i], tokens[i - 1] + tokens[i], i, i, i - 1) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, total, i, vi, vj = heapq.heappop(heap)
        if not alive[i] or version[i] != vi or left[i] < 0 or version[left[i]] != vj:
            continue
        j = left[i]
        if total + (overlap if left[j] >= 0 else 0) > room:
            continue
        end[j], tokens[j], alive[i] = end[i], total, False
        version[j], stamp = stamp, stamp + 1
        right[j] = right[i]
        if right[i] >= 0:
            left[right[i]] = j
            k = right[i]
            heapq.heappush(heap, (-strength[k], tokens[j] + tokens[k], k, version[k], version[j]))
        if left[j] >= 0:
            heapq.heappush(heap, (-strength[j], tokens[left[j]] + tokens[j], j, version[j], version[left[j]]))
    return [(begin[i], end[i]) for i in range(n) if alive[i]]


def tail_start(text: str, end: int, enc, overlap: int) -> int:
    """Where the last ``overlap`` tokens of text[:end] start, at a character."""
    window = min(end, max(64, overlap * 12))
    while True:
        part = text[end - window : end]
        ids = enc.encode_ordinary(part)
        if len(ids) >= overlap + 4 or window >= end:
            break
        window = min(end, window * 2)
    if len(ids) <= overlap:
        return end - window
    tail = enc.decode_bytes(ids[-overlap:])
    drop = 0
    while drop < len(tail) and tail[drop] & 0xC0 == 0x80:  # not inside a character
        drop += 1
    return end - len(tail[drop:].decode("utf-8", "ignore"))


def word_begin(text: str, at: int) -> int:
    """The begin of the word that ``at`` lies in, if it is near."""
    for back in range(min(at, 24)):
        if text[at - back - 1].isspace():
            return at - back
    return at


def split_text(text: str, limit: int, overlap: int, enc, whole: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(begin, own_begin, end, tokens, overlap tokens) of the pieces; text[begin:own_begin] is shared with the pieces before."""
    size = lambda t: len(enc.encode_ordinary(t))
    if (size(text) if whole is None else whole) <= limit:
        return []
    overlap = max(0, min(overlap, limit - max(1, limit // 10)))
    slack = min(SLACK, limit // 8, max(0, limit - overlap - 1))
    room = limit - slack
    parts = atoms(text, size, max(1, room - overlap))
    out: list[tuple[int, int, int, int, int]] = []
    for begin, end in merge(parts, room, overlap):
        start = begin
        if out and overlap:
            start = tail_start(text, begin, enc, overlap)
            whole = word_begin(text, start)
            if size(text[whole:end]) <= limit:
                start = whole
        n = size(text[start:end])
        while n > limit and start < begin:  # the seam costs more than the slack
            start += max(1, min((n - limit) * 2, begin - start))
            n = size(text[start:end])
        out.append((start, begin, end, n, size(text[start:begin])))
    return out


def with_limits(documents: DataFrame, plan: DataFrame) -> DataFrame:
    limits = plan.select("source", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens"))
    return documents.select("doc_id", "source", "text").join(limits, "source")


def oversized(documents: DataFrame, plan: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, n_tokens) of the documents over the limit of their source, as the splitter cuts them."""
    pieces = split(documents, plan, path)
    return pieces.filter("piece_no = 1").select("doc_id", "n_pieces", "doc_tokens")


def split(documents: DataFrame, plan: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, piece_no, n_pieces, doc_tokens, begin_char, overlap_chars, overlap_tokens, n_tokens, piece) of the oversized documents."""
    path = path or TOKENIZER

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoding(path)
        for batch in batches:
            rows = []
            for doc, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not text or limit is None or limit < 1:
                    continue
                whole = len(enc.encode_ordinary(text))
                pieces = split_text(text, limit, overlap, enc, whole)
                for k, (start, own, end, n, shared) in enumerate(pieces, 1):
                    rows.append((doc, k, len(pieces), whole, start, own - start, shared, n, text[start:end]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    import pyarrow as pa

    names = ["doc_id", "piece_no", "n_pieces", "doc_tokens", "begin_char", "overlap_chars", "overlap_tokens", "n_tokens", "piece"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return (
        with_limits(documents, plan)
        .filter(F.octet_length("text") > F.col("max_tokens"))  # a token has a byte at least
        .select("doc_id", "text", "max_tokens", "overlap_tokens")
        .mapInArrow(
            run,
            "doc_id long, piece_no int, n_pieces int, doc_tokens long, begin_char long, overlap_chars long, overlap_tokens long, n_tokens long, piece string",
        )
    )
