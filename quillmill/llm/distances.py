"""Edit distances of many pairs of texts at once.

The columns of the distance table are kept as bits of where it rises and falls (Myers 1999, in words of 64 letters
after Hyyrö 2003), and one NumPy operation moves all pairs on by a letter. The distances are exact.
"""

from __future__ import annotations

import numpy as np

#: Pairs moved on together; letters of a text up to which that pays, longer ones are compared one pair at a time.
TOGETHER, LONGEST = 2048, 256


def one_pair(short: str, long: str) -> tuple[int, int]:
    """Distance of the short text from the long one, and from as many letters of its front: one pair, of any length."""
    where: dict[str, int] = {}
    for i, c in enumerate(short):
        where[c] = where.get(c, 0) | 1 << i
    whole = (1 << len(short)) - 1
    rise, fall, front = whole, 0, 0
    for j, c in enumerate(long, 1):
        eq = where.get(c, 0)
        across = (((eq & rise) + rise) ^ rise) | eq
        up, down = fall | ~(across | rise) & whole, rise & across
        up, down = (up << 1 | 1) & whole, down << 1 & whole
        rise, fall = down | ~(eq | fall | up) & whole, up & (eq | fall)
        if j == len(short):
            front = j + rise.bit_count() - fall.bit_count()
    return len(long) + rise.bit_count() - fall.bit_count(), front


def _together(short: np.ndarray, long: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``one_pair`` of each row: letters as numbers from 1, lengths ``m`` <= ``n``."""
    rows, words, one = len(m), -(-short.shape[1] // 64), np.uint64(1)
    # Each pair's letters get numbers of their own; 0 is a letter that no short text has.
    seen = np.zeros(int(max(short.max(), long.max())) + 1, bool)
    seen[short] = True
    seen[0] = False
    number = np.cumsum(seen) * seen
    size = int(number.max()) + 1
    base = np.arange(rows) * size
    where = np.zeros((words, rows * size), np.uint64)
    for i, at in enumerate(np.ascontiguousarray((number[short] + base[:, None]).T)):
        where[i // 64][at] |= one << np.uint64(i % 64)
    where[:, base] = 0
    bits = np.clip(m - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
    mask = np.where(bits == 64, ~np.uint64(0), (one << (bits % np.uint64(64))) - one)
    rise, fall = [np.full(rows, ~np.uint64(0)) for _ in range(words)], [np.zeros(rows, np.uint64) for _ in range(words)]
    out = np.zeros((2, rows), np.int64)
    # The pairs of which a text ends at each letter.
    ends = [(k, np.argsort(x, kind="stable"), np.searchsorted(np.sort(x), np.arange(1, long.shape[1] + 2)).tolist()) for k, x in enumerate((n, m))]
    for j, at in enumerate(np.ascontiguousarray((number[long] + base[:, None]).T), 1):
        up_in = one
        for w in range(words):
            eq, r, f = where[w].take(at), rise[w], fall[w]
            xv = eq | f
            if w:
                eq |= down_in
            across = (((eq & r) + r) ^ r) | eq
            up, down = f | ~(across | r), r & across
            shifted, down_shifted = up << one, down << one
            shifted |= up_in
            if w:
                down_shifted |= down_in
            if w < words - 1:
                up_in, down_in = up >> np.uint64(63), down >> np.uint64(63)
            rise[w], fall[w] = down_shifted | ~(xv | shifted), shifted & xv
        for k, order, begins in ends:
            if begins[j] > begins[j - 1]:
                ids = order[begins[j - 1] : begins[j]]
                out[k, ids] = j + sum(np.bitwise_count(rise[w][ids] & mask[w, ids]).astype(np.int64) - np.bitwise_count(fall[w][ids] & mask[w, ids]) for w in range(words))
    return out[0], out[1]


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points from 1 of all texts one after the other, and where each text begins."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int32) + 1, np.concatenate([[0], np.cumsum(list(map(len, texts)))]).astype(np.int64)


def _letters(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, back: bool) -> np.ndarray:
    """The first ``sizes`` letters of each text, or the last ones from the back, a row each; 0 beyond."""
    k = np.arange(int(sizes.max(initial=1)))
    at = starts[:, None] + (-1 - k if back else k)
    out = codes.take(at, mode="clip")
    out *= k < sizes[:, None]
    return out


def edit_distances(a: list[str], b: list[str], least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of texts: the distance, and those of the shorter text from as many letters of the longer one's front and back.

    The latter two are the first one where the shorter text has fewer than ``least`` letters.
    """
    x, xs = _numbered(a)
    y, ys = _numbered(b)
    codes, first = np.concatenate([x, y, np.zeros(1, np.int32)]), np.diff(xs) <= np.diff(ys)
    starts = np.where(first, (xs[:-1], ys[:-1] + len(x)), (ys[:-1] + len(x), xs[:-1]))
    m, n = np.minimum(np.diff(xs), np.diff(ys)), np.maximum(np.diff(xs), np.diff(ys))
    whole, front = n.copy(), np.zeros_like(n)
    back = front.copy()
    ends = (m < n) & (m >= max(least, 1))
    for i in np.flatnonzero(n > LONGEST):
        s, t = (a[i], b[i]) if first[i] else (b[i], a[i])
        if m[i]:
            whole[i], front[i] = one_pair(s, t)
        if ends[i]:
            back[i] = one_pair(s, t[-len(s) :])[0]
    few = (n <= LONGEST) & (m > 0)
    for reverse, todo, texts in ((False, np.flatnonzero(few), n), (True, np.flatnonzero(few & ends), m)):
        todo = todo[np.lexsort((texts[todo], (m[todo] - 1) // 64))]
        for lo in range(0, len(todo), TOGETHER):
            i = todo[lo : lo + TOGETHER]
            short, long = (_letters(codes, s[i] + z[i] * reverse, w[i], reverse) for s, z, w in ((starts[0], m, m), (starts[1], n, texts)))
            got = _together(short, long, m[i], texts[i])
            if reverse:
                back[i] = got[0]
            else:
                whole[i], front[i] = got
    return whole, np.where(ends, front, whole), np.where(ends, back, whole)
