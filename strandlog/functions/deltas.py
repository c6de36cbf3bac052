"""Edit scripts between byte strings: (position, deleted, inserted bytes) against the older string.

`approximate` anchors on q-grams that both strings have, in order; `exact` minimises the cost by dynamic programming.
Scripts are checked by applying them, and a whole replacement is given where an anchor's padding was misread, so that
`apply(ops, old) == new` for all strings.
"""

from __future__ import annotations

from collections import Counter, deque

import numpy as np

Op = tuple[int, int, bytes]
#: Cells of the table of `exact` at most.
EXACT_CELLS = 1 << 18


def apply(ops: list[Op], old: bytes) -> bytes:
    out, at = [], 0
    for position, deleted, new in ops:
        out += (old[at:position], new)
        at = position + deleted
    out.append(old[at:])
    return b"".join(out)


def script_cost(ops: list[Op]) -> float:
    return 5.0 + sum(3.0 + len(new) for _, _, new in ops)


def _padded(s: bytes, q: int) -> list[tuple[int, ...]]:
    """q-grams of a string between q - 1 start marks (-1) and end marks (-2), which no byte equals."""
    t = (-1,) * (q - 1) + tuple(s) + (-2,) * (q - 1)
    return [t[i : i + q] for i in range(len(t) - q + 1)]


def _matches(old: list, new: list) -> list[tuple[int, int]]:
    """Places of equal grams, both rising: each old gram takes the next equal new one if any is left there."""
    mine = set(old)
    left = Counter(g for g in new if g in mine)
    shared = deque((g, i) for i, g in enumerate(new) if g in mine)
    out = []
    for i, g in enumerate(old):
        if not left.get(g):
            continue
        while shared and shared[0][0] != g:
            left[shared.popleft()[0]] -= 1
        if shared:
            left[g] -= 1
            out.append((i, shared.popleft()[1]))
    return out


def _runs(matches: list[tuple[int, int]], q: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Diagonal runs (first, last), taken from the right; a match too near to the run after it is dropped."""
    runs: list[list[tuple[int, int]]] = []
    for m in reversed(matches):
        if not runs:
            runs.append([m, m])
            continue
        head = runs[-1][0]
        gap = head[0] - m[0], head[1] - m[1]
        if gap == (1, 1):
            runs[-1][0] = m
        elif min(gap) >= q:
            runs.append([m, m])
    return [(a, b) for a, b in reversed(runs)]


def approximate(old: bytes, new: bytes, q: int = 3) -> tuple[list[Op], float]:
    """(script, cost) by q-gram anchors."""
    ops: list[Op] = []
    at_old = at_new = 0  # first bytes not covered yet
    for first, last in _runs(_matches(_padded(old, q), _padded(new, q)), q):
        x, y = max(0, first[0] - q + 1), max(0, first[1] - q + 1)
        if x or y:
            ops.append((at_old, x - at_old, new[at_new:y]))
        at_old, at_new = min(last[0], len(old) - 1) + 1, min(last[1], len(new) - 1) + 1
    if at_old != len(old) or at_new != len(new):
        ops.append((at_old, len(old) - at_old, new[at_new:]))
    if any(d < 0 for _, d, _ in ops) or apply(ops, old) != new:
        ops = [(0, len(old), new)]
    return ops, script_cost(ops)


def _tables(pairs: list[tuple[bytes, bytes]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(cost, came) by row, pair and column: came is the place (row * columns + column) a substitution begins in, -1 where bytes are equal.

    A substitution that ends at (x, y) begins in an earlier cell (p, r), looked at from the last to the first, rows
    before columns, up to the first cell from which old and new bytes have `most` in common in order. That cell is the
    greatest first place of such a chain of equal bytes, which is carried from row to row (`chain`). So the cells are
    whole rows after that place's, up to column y - 1, and a part of its own row: two minima over ranges, read from
    minima over powers of two. A key orders by cost, then by the later cell, so that minima are the first ones met. A row
    needs earlier rows only; it is computed for all columns and pairs at once.
    """
    rows, width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs) + 1
    size, n = len(pairs), width - 1
    old, new = np.full((rows, size, 1), -1, np.int16), np.full((size, n), -2, np.int16)
    for i, (a, b) in enumerate(pairs):
        old[: len(a), i, 0], new[i, : len(b)] = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    cells = (rows + 1) * width
    kind = np.int32 if (width + 8) * cells < 1 << 30 and (rows + 1) * size * width < 1 << 30 else np.int64
    none = np.iinfo(kind).max
    column = np.arange(width, dtype=kind)
    log = np.zeros(max(rows, width) + 2, np.intp)
    for i in range(2, len(log)):
        log[i] = log[i // 2] + 1
    high, wide = int(log[rows]) + 1, int(log[width]) + 1
    cost, came = np.zeros((rows + 1, size, width), kind), np.full((rows + 1, size, width), -1, np.int32)
    upto = np.empty((high, rows + 1, size, width), kind)  # minima of keys: of columns up to one, of 2^k rows up to one
    inside = np.empty((wide, rows + 1, size, width), kind)  # of 2^k columns up to one, of one row
    chain = np.full((most + 1, size, width), -1, kind)
    at = (np.arange(size) * width)[:, None] + np.arange(n)  # (pair, y - 1) within a row
    plane, row = (rows + 1) * size * width, size * width
    flat_upto, flat_inside = upto.reshape(-1), inside.reshape(-1)
    for x in range(rows + 1):
        if not x:
            cost[0, :, 1:], came[0, :, 1:] = 3 + column[1:], column[:-1]
        else:
            same = old[x - 1] == new
            for k in range(most, 0, -1):
                begin = chain[k - 1, :, :-1] if k > 1 else ((x - 1) * width + column[:-1])[None]
                c = chain[k, :, 1:]
                np.maximum.accumulate(np.maximum(c, np.where(same, begin, -1)), axis=1, out=c)
            p, r = np.divmod(chain[most, :, 1:], width)
            length = x - 1 - p
            level = log[np.maximum(length, 1)]
            last, first = level * plane + (x - 1) * row + at, level * plane + (p + (1 << level)) * row + at
            best = np.minimum(flat_upto[last], flat_upto[np.where(length > 0, first, last)])
            if most == 1:
                best[length < 1] = none
            part = np.flatnonzero((p >= 0) & (r < column[:-1]) & ~same)
            if len(part):
                p, r, base = p.reshape(-1)[part].astype(np.intp), r.reshape(-1)[part].astype(np.intp), at.reshape(-1)[part]
                y = base % width
                level = log[y - r]
                begin = level * plane + p * row + base
                flat = best.reshape(-1)
                flat[part] = np.minimum(flat[part], np.minimum(flat_inside[begin], flat_inside[begin - y + r + (1 << level)]))
            g, place = np.divmod(best, cells)
            cost[x, :, 0], came[x, :, 0] = 3, (x - 1) * width
            cost[x, :, 1:] = np.where(same, cost[x - 1, :, :-1], g + column[1:])
            came[x, :, 1:] = np.where(same, -1, cells - 1 - place)
        key = (cost[x] + np.where(came[x] < 0, kind(3), kind(0)) - column) * kind(cells) + (cells - 1 - x * width - column)
        inside[0, x] = key
        for k in range(1, wide):
            step = 1 << (k - 1)
            inside[k, x] = inside[k - 1, x]
            np.minimum(inside[k - 1, x, :, step:], inside[k - 1, x, :, :-step], out=inside[k, x, :, step:])
        np.minimum.accumulate(key, axis=1, out=upto[0, x])
        for k in range(1, high):
            if x + 1 >= 1 << k:
                np.minimum(upto[k - 1, x], upto[k - 1, x - (1 << (k - 1))], out=upto[k, x])
    return cost, came


def _trace(came: np.ndarray, new: bytes, m: int, width: int) -> list[Op]:
    """The script that ends in cell (m, len(new)) of a pair's table."""
    ops: list[Op] = []
    i, j = m, len(new)
    while i or j:
        place = int(came[i, j])
        if place < 0:
            i, j = i - 1, j - 1
            continue
        p, r = divmod(place, width)
        if ops and ops[-1][0] == i:  # next to the substitution after it
            _, deleted, text = ops.pop()
            ops.append((p, i - p + deleted, new[r:j] + text))
        else:
            ops.append((p, i - p, new[r:j]))
        i, j = p, r
    return ops[::-1]


def exact_many(pairs: list[tuple[bytes, bytes]], most: int = 3) -> list[tuple[list[Op], float]]:
    """`exact` of each pair (old, new): pairs of like lengths share tables of about EXACT_CELLS cells."""
    out: list = [None] * len(pairs)
    rest = []
    for i, (old, new) in enumerate(pairs):
        if len(old) * len(new) > EXACT_CELLS:
            raise ValueError(f"strings of {len(old)} and {len(new)} bytes are too long for exact scripts; use approximate ones")
        if old == new:
            out[i] = [], 0.0
        elif not old or not new:
            out[i] = [(0, len(old), new)], 5.0 + len(new)
        else:
            rest.append(i)
    rest.sort(key=lambda i: (len(pairs[i][0]) // 8, len(pairs[i][1])))
    begin = 0
    while begin < len(rest):
        end = begin
        rows = width = 0
        while end < len(rest):
            a, b = pairs[rest[end]]
            rows, width = max(rows, len(a) + 1), max(width, len(b) + 1)
            if end > begin and rows * width * (end + 1 - begin) > EXACT_CELLS:
                break
            end += 1
        some = [pairs[i] for i in rest[begin:end]]
        cost, came = _tables(some, most)
        for k, i in enumerate(rest[begin:end]):
            old, new = pairs[i]
            out[i] = _trace(came[:, k], new, len(old), came.shape[2]), float(cost[len(old), k, len(new)])
        begin = end
    return out


def exact(old: bytes, new: bytes, most: int = 3) -> tuple[list[Op], float]:
    """(script, cost) of least cost: 3 for each substitution and 1 for each new byte; equal bytes are always kept.

    The work grows with the product of the lengths: pairs of more than EXACT_CELLS bytes by bytes raise ValueError.
    """
    return exact_many([(old, new)], most)[0]
