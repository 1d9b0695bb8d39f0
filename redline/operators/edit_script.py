"""Shortest edit script of two code sequences: greedy furthest-reaching paths, split at the middle snake.

Time grows with the length times the number of edits, at most with the product of the lengths; memory with the length. Codes
that only one side has are edits in any case and leave before the search. All diagonals of one edit distance advance
together in numpy; short sequences are walked as lists, by the same rules.

Order of ties: common ends of a box are matched before it is split. A box is split at the first overlap found, forward
paths before backward ones, the smallest diagonal (place in ``a`` minus place in ``b``) first. Where the squared distance
exceeds a 64th of the product of the lengths, paths are given up and the box is split at the middle of ``a`` and the first
place of ``b`` where the scores of both halves add up highest.
"""

from __future__ import annotations

import numpy as np

FAR = -(1 << 60)
SMALL = 1024   # codes of both sides up to which plain lists are faster than arrays
BITS = 4096    # codes of one side whose score row is kept as the bits of one number


def _common_start(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, by windows that double."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = np.flatnonzero(a[at:min(at + step, n)] != b[at:min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _advance(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Follow equal codes on every diagonal; places that lie outside the box stay where they are."""
    x = x.copy()
    gap = y - x
    live = np.flatnonzero((x >= 0) & (y >= 0) & (x < len(a)) & (y < len(b)))
    while len(live):
        if len(live) == 1:
            k = live[0]
            x[k] += _common_start(a[x[k]:], b[x[k] + gap[k]:])
            break
        live = live[a[x[live]] == b[x[live] + gap[live]]]
        x[live] += 1
        live = live[(x[live] < len(a)) & (x[live] + gap[live] < len(b))]
    return x


def _halve(a, b) -> int:
    """The first split of ``b`` that goes best with the halves of ``a``."""
    def scores(x, y):
        if len(y) <= BITS:  # a bit is cleared where the score goes up by one
            at: dict[int, int] = {}
            for i, code in enumerate(y):
                at[code] = at.get(code, 0) | 1 << i
            every = row = (1 << len(y)) - 1
            for code in x:
                hit = row & at.get(code, 0)
                row = (row + hit | row - hit) & every
            bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")
            return np.concatenate([[0], np.cumsum(1 - bits[:len(y)].astype(np.int32))])
        x, y = np.asarray(x), np.asarray(y)
        row = np.zeros(len(y) + 1, np.int32)
        for code in x:
            row[1:] = np.maximum.accumulate(np.where(y == code, row[:-1] + 1, row[1:]))
        return row

    half = len(a) // 2
    return int(np.argmax(scores(a[:half], b) + scores(a[half:][::-1], b[::-1])[::-1]))


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(x, y, length) of a snake in the middle of a shortest script; both sides are non-empty."""
    n, m = len(a), len(b)
    delta, zero = n - m, n + m + 2
    sides = [(a, b, np.full(2 * zero + 2, FAR)), (a[::-1], b[::-1], np.full(2 * zero + 2, FAR))]
    for _, _, v in sides:
        v[zero + 1] = 0
    for d in range((n + m + 1) // 2 + 1):
        if n > 1 and 64 * d * d > n * m + 16_384:
            return n // 2, _halve(a.tolist(), b.tolist()), 0
        low, high = max(-d, -m), min(d, n)
        ks = np.arange(low + ((low + d) & 1), high + 1, 2)
        for side in (0, 1):
            p, q, v = sides[side]
            start = np.maximum(v[zero + ks - 1] + 1, v[zero + ks + 1])
            start[(start > n) | (start - ks > m) | (start < 0) | (start < ks)] = FAR
            end = _advance(p, q, start, start - ks)
            v[zero + ks] = end
            if (delta & 1 == 1) == (side == 0):
                other = sides[1 - side][2]
                facing = delta - ks
                met = (np.abs(facing) <= d - (side == 0)) & (end + other[zero + np.clip(facing, -zero, zero)] >= n)
                if met.any():
                    at = int(np.flatnonzero(met)[0 if side == 0 else -1])
                    x0, x1, k = int(start[at]), int(end[at]), int(ks[at])
                    return (x0, x0 - k, x1 - x0) if side == 0 else (n - x1, m - (x1 - k), x1 - x0)
    raise AssertionError("paths from both ends always meet")


def _middle_of_lists(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """:func:`_middle`, one diagonal at a time."""
    n, m = len(a), len(b)
    delta, zero = n - m, n + m + 2
    sides = [(a, b, [FAR] * (2 * zero + 2)), (a[::-1], b[::-1], [FAR] * (2 * zero + 2))]
    for _, _, v in sides:
        v[zero + 1] = 0
    for d in range((n + m + 1) // 2 + 1):
        if n > 1 and 64 * d * d > n * m + 16_384:
            return n // 2, _halve(a, b), 0
        low, high = max(-d, -m), min(d, n)
        for side in (0, 1):
            p, q, v = sides[side]
            other, reach, found = sides[1 - side][2], d - (side == 0), None
            meets = (delta & 1 == 1) == (side == 0)
            for k in range(low + ((low + d) & 1), high + 1, 2):
                x = start = max(v[zero + k - 1] + 1, v[zero + k + 1])
                if start > n or start - k > m or start < 0 or start < k:
                    v[zero + k] = FAR
                    continue
                while x < n and x - k < m and p[x] == q[x - k]:
                    x += 1
                v[zero + k] = x
                if meets and abs(delta - k) <= reach and x + other[zero + delta - k] >= n:
                    found = start, x, k
                    if side == 0:
                        return start, start - k, x - start
            if found:
                x0, x1, k = found
                return n - x1, m - (x1 - k), x1 - x0
    raise AssertionError("paths from both ends always meet")


def _common_parts_of_lists(a: list[int], b: list[int]) -> tuple[list[bool], list[bool]]:
    keep_a, keep_b = [False] * len(a), [False] * len(b)
    boxes = [(0, len(a), 0, len(b))]
    while boxes:
        a0, a1, b0, b1 = boxes.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            keep_a[a0] = keep_b[b0] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            keep_a[a1] = keep_b[b1] = True
        if a0 < a1 and b0 < b1:
            x, y, size = _middle_of_lists(a[a0:a1], b[b0:b1])
            x, y = a0 + x, b0 + y
            keep_a[x:x + size] = keep_b[y:y + size] = [True] * size
            boxes += [(a0, x, b0, y), (x + size, a1, y + size, b1)]
    return keep_a, keep_b


def common_parts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the members of one longest common subsequence in both sides; what is unmarked is the edit script."""
    at_a, at_b = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    keep_a, keep_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a, b = a[at_a], b[at_b]
    if len(a) + len(b) <= SMALL:
        keep_a[at_a], keep_b[at_b] = _common_parts_of_lists(a.tolist(), b.tolist())
        return keep_a, keep_b
    boxes = [(0, len(a), 0, len(b))]
    while boxes:
        a0, a1, b0, b1 = boxes.pop()
        head = _common_start(a[a0:a1], b[b0:b1])
        keep_a[at_a[a0:a0 + head]] = keep_b[at_b[b0:b0 + head]] = True
        a0, b0 = a0 + head, b0 + head
        tail = _common_start(a[a0:a1][::-1], b[b0:b1][::-1])
        keep_a[at_a[a1 - tail:a1]] = keep_b[at_b[b1 - tail:b1]] = True
        a1, b1 = a1 - tail, b1 - tail
        if a0 < a1 and b0 < b1:
            x, y, size = _middle(a[a0:a1], b[b0:b1])
            x, y = a0 + x, b0 + y
            keep_a[at_a[x:x + size]] = keep_b[at_b[y:y + size]] = True
            boxes += [(a0, x, b0, y), (x + size, a1, y + size, b1)]
    return keep_a, keep_b
