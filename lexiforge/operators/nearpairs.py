"""All pairs of strings whose Indel ratio reaches a threshold, by comparing every pair of a tile in numpy.

A pair is left out only by a bound that holds for every pair: by the lengths, and by signatures. A signature has a bit for each
(character, how often it came before), hashed; each bit in which two signatures differ costs at least one edit. What is left
is decided by the length of the longest common subsequence, bit-parallel.
"""

from __future__ import annotations

import numpy as np

ROWS, PAIRS = 256, 200_000


def signatures(strings: list[str]) -> np.ndarray:
    """(n, 2) words of 64 bits."""
    out = np.zeros((len(strings), 2), np.uint64)
    for k, s in enumerate(strings):
        seen: dict[str, int] = {}
        bits = 0
        for ch in s:
            n = seen[ch] = seen.get(ch, -1) + 1
            bits |= 1 << ((ord(ch) & 31) + 32 * n) % 128
        out[k] = bits & (1 << 64) - 1, bits >> 64
    return out


def codes(strings: list[str], lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(n, longest) numbers of the characters, 0 behind the end; and the size of the alphabet with 0."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, number = np.unique(flat, return_inverse=True)
    out = np.zeros((len(strings), int(lengths.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = number + 1
    return out, len(alphabet) + 1


def lcs_long(a: np.ndarray, b: np.ndarray) -> int:
    """One pair of any length, by an integer of as many bits as a is long."""
    masks: dict[int, int] = {}
    for k, ch in enumerate(a.tolist()):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = v = (1 << len(a)) - 1
    for ch in b.tolist():
        u = v & masks.get(ch, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def lcs_batch(a: np.ndarray, la: int, b: np.ndarray, lb: np.ndarray, ia: np.ndarray, ib: np.ndarray, size: int) -> np.ndarray:
    """LCS of the rows a[ia], all of length la, with b[ib]."""
    if la > 64:
        return np.array([lcs_long(a[i, :la], b[j, : lb[j]]) for i, j in zip(ia, ib)], np.int64)
    masks = np.zeros((len(a), size), np.uint64)
    rows = np.arange(len(a))
    for k in range(la):
        masks[rows, a[:, k]] |= np.uint64(1 << k)
    masks[:, 0] = 0
    masks = masks.ravel()
    out = np.empty(len(ia), np.int64)
    full = np.uint64((1 << la) - 1)
    for at in range(0, len(ia), PAIRS // 10):
        cut = slice(at, at + PAIRS // 10)
        base, text = ia[cut] * size, b[ib[cut], : int(lb[ib[cut]].max())].T.copy()
        v = np.full(len(base), full)
        for ch in text:
            u = v & masks[base + ch]
            v = (v + u) | (v - u)
        out[cut] = la - np.bitwise_count(v & full)
    return out


def near_pairs(left: list[str], right: list[str] | None, threshold: float):
    """Yields (a, b, ratio) arrays: every pair of left with right, or of left with itself (right None), once."""
    n = len(left)
    strings = left + (right or [])
    if not n or right == []:
        return
    lengths = np.array([len(s) for s in strings], np.int64)
    text, size = codes(strings, lengths)
    sig = signatures(strings)
    own = np.arange(n)
    if right is None:
        sides = [(own, own, True)]
    else:
        other = np.arange(n, len(strings))
        sides = [(own, other, True), (other, own, False)]  # the shorter one is the row; equal lengths come in the first
    t = threshold / 100.0
    names = np.array(strings, object)
    for short, long, equal in sides:
        short, long = short[np.argsort(lengths[short], kind="stable")], long[np.argsort(lengths[long], kind="stable")]
        ls, ll = lengths[short], lengths[long]
        for la in np.unique(ls).tolist():
            rows = short[ls == la]
            lo = np.searchsorted(ll, la, "left" if equal else "right")
            hi = np.searchsorted(ll, la * (2 - t) / t + 1e-6, "right") if t > 0 else len(ll)
            cols = long[lo:hi]
            if not len(cols):
                continue
            budget = np.floor((1 - t) * (la + lengths[cols]) + 1e-6)
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                for start in range(0, len(cols), PAIRS // ROWS * 8):
                    some = cols[start : start + PAIRS // ROWS * 8]
                    differ = np.bitwise_count(sig[part, 0, None] ^ sig[None, some, 0]) + np.bitwise_count(sig[part, 1, None] ^ sig[None, some, 1])
                    ia, ib = np.nonzero(differ <= budget[start : start + len(some)].clip(0, 255).astype(np.uint8))
                    if right is None:  # a pair of equal lengths once, no string with itself
                        keep = (lengths[some[ib]] > la) | (part[ia] < some[ib])
                        ia, ib = ia[keep], ib[keep]
                    if not len(ia):
                        continue
                    lcs = lcs_batch(text[part], la, text[some], lengths[some], ia, ib, size)
                    ratio = 200.0 * lcs / (la + lengths[some[ib]])
                    good = ratio >= threshold
                    if good.any():
                        yield names[part[ia[good]]], names[some[ib[good]]], ratio[good]
