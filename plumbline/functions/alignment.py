"""Smallest k-mer hashes of sequences, and alignment of two from a common place on, on numpy arrays.

Alignment follows errors, not cells: its steps are as many as the errors of the best alignment, each over a band of
diagonals, so two long sequences that differ little take little time.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20  # code points of a sequence that are hashed at once
DROP = 100  # points below the best at which an extension ends
GROUP = 200_000  # characters of pairs that are aligned at once


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def smallest_kmers(text: str, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m smallest hashes of k consecutive characters, and where each first stands; a shorter text is one k-mer."""
    points = code_points(text).astype(np.uint64)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = min(k, len(points))
    best, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(points) - width + 1, PIECE):
        part = points[at : at + PIECE + width - 1]
        n = len(part) - width + 1
        h = np.full(n, width, np.uint64)
        for j in range(width):
            h = mixed(h + part[j : j + n] * np.uint64(0x9E3779B97F4A7C15))
        near = np.flatnonzero(h <= np.partition(h, m - 1)[m - 1]) if n > m else np.arange(n)
        # repeats may crowd out other values, then all are looked at
        found, first = np.unique(h[near], return_index=True)
        if len(found) < m < n:
            found, first = np.unique(h, return_index=True)
            near = np.arange(n)
        h, p = np.concatenate((best, found)), np.concatenate((where, near[first] + at))
        best, first = np.unique(h, return_index=True)
        best, where = best[:m], p[first[:m]]
    return best.view(np.int64), where


def gram_counts(points: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of q consecutive characters, rising, and how often each occurs."""
    n = max(0, len(points) - q + 1)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : j + n].astype(np.uint64)
    return np.unique(h, return_counts=True)


def may_match(a: np.ndarray, b: np.ndarray, identity: float, cover: float) -> bool:
    """False only where no alignment of such an identity covers so much of both.

    One over n characters has at most r * n errors, r being (1 - identity) / (1 + identity) * 2, and each spoils q grams at
    most; so the two must share the other grams of the part it covers.
    """
    r = 2 * (1 - identity) / (1 + identity)
    if r >= 0.5:
        return True
    q = max(1, min(12, int(2 / (3 * r)) if r else 12))
    (x, n), (y, m) = gram_counts(a, q), gram_counts(b, q)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = (1 - q * r) * cover * max(len(a), len(b)) - q + 1
    return np.minimum(n[i], m[j]).sum() >= least - 1e-6


def next_mismatches(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """For each diagonal and place of a, the place where the diagonal next differs or ends."""
    n = len(a)
    left, right = np.full(n + 1, -2, np.int64), np.full(n + 1 + 2 * band, -1, np.int64)
    left[:n] = a
    reach = b[: n + 1 + band]
    right[band : band + len(reach)] = reach
    differs = np.lib.stride_tricks.sliding_window_view(right, n + 1)[::-1] != left
    out = np.where(differs, np.arange(n + 1, dtype=np.int32), np.int32(n))
    return np.minimum.accumulate(out[:, ::-1], axis=1)[:, ::-1]


_NOWHERE = np.int64(-(1 << 40))


def reached(a: list[np.ndarray], b: list[np.ndarray], band: int, most: np.ndarray) -> np.ndarray:
    """Errors, and the characters of a and b, of the best alignments of a start of each a with a start of its b.

    One scores half a point for each character less two for each error: a character changed, or one without a partner.  Of
    equal scores the one with fewest errors counts, of these the one with least of a.  Both ends stay within ``band``
    diagonals of each other, and errors within ``most``.  For every number of errors the furthest place on each diagonal
    is found from those with one error less, for all pairs at once; from there matches are free, up to the diagonal's next
    mismatch.  A place that scores DROP points less than the best so far isn't followed further.  No more errors are tried
    once even a match of all that is left couldn't score better.
    """
    lanes = np.arange(-band, band + 1)
    n, m = (np.array([len(x) for x in side], np.int64)[:, None] for side in (a, b))
    limit = np.minimum(n, m + lanes)
    limit[(limit < 0) | (lanes > n)] = _NOWHERE
    tables = [next_mismatches(x, y, band).ravel() for x, y in zip(a, b, strict=True)]
    base = np.cumsum([0, *(len(t) for t in tables)])[:-1, None] + np.arange(len(lanes)) * (n + 1)
    table = np.concatenate(tables)
    out = np.zeros((3, len(a)), np.int64)
    score = np.zeros(len(a), np.int64)  # in half points
    at = np.full(limit.shape, _NOWHERE)
    at[:, band] = 0
    pair = np.arange(len(a))  # those still going on
    for errors in range(int(most.max()) + 1):
        if errors:
            step = at.copy()
            np.maximum(step[:, 1:], at[:, :-1], out=step[:, 1:])  # a character of a changed, or alone
            step += 1
            np.maximum(step[:, :-1], at[:, 1:], out=step[:, :-1])  # one of b alone
            at = np.minimum(step, limit[pair])
        alive = at >= 0
        at = np.where(alive, table[np.where(alive, at, 0) + base[pair]], _NOWHERE)
        found = 2 * at - lanes - 4 * errors
        k = found.argmax(axis=1)
        top = found[np.arange(len(pair)), k]
        up = np.flatnonzero(top > score[pair])
        if len(up):
            ends = at[up, k[up]]
            score[pair[up]] = top[up]
            out[:, pair[up]] = np.full(len(up), errors), ends, ends - lanes[k[up]]
        at[found < score[pair][:, None] - 2 * DROP] = _NOWHERE
        going = ((n + m)[pair, 0] - 4 * (errors + 1) > score[pair]) & (at >= 0).any(axis=1) & (most[pair] > errors)
        if not going.all():
            pair, at = pair[going], at[going]
            if not len(pair):
                break
    return out


def extended(a: list[np.ndarray], b: list[np.ndarray], i: list[int], j: list[int], band: int, identity: float) -> np.ndarray:
    """A row for each pair: its identity, errors over mean aligned length taken from 1, and the aligned shares of a and b.

    The alignment is the best one through place i of a and j of b, both ways, with no more errors a way than ``identity``
    allows.
    """
    out = np.zeros((len(a), 3))
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    order = np.argsort(total, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(np.cumsum(total[order]) // GROUP)) + 1):
        if not len(rows):
            continue
        most = ((1 - identity) * total[rows] / 2).astype(np.int64)
        right = reached([a[r][i[r] :] for r in rows], [b[r][j[r] :] for r in rows], band, most)
        left = reached([a[r][: i[r]][::-1] for r in rows], [b[r][: j[r]][::-1] for r in rows], band, most)
        errors, x, y = right + left
        sizes = [np.array([len(side[r]) for r in rows]) for side in (a, b)]
        out[rows] = np.column_stack((1 - 2 * errors / np.maximum(1, x + y), x / sizes[0], y / sizes[1]))
    return out
