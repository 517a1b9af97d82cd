"""Longest common subsequences of lines, exact at every size.

One row of the dynamic programme is a bit vector, a bit per line of the second text, held in
one Python integer: a step costs a few operations on whole words. Where to cut is found from two
such rows, one from the front and one from the back, so the memory stays linear.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bytes of bit masks that are kept for lines seen again; others are made anew.
_KEPT_BYTES = 64 << 20


def _row(x: Sequence[int], y: np.ndarray) -> np.ndarray:
    """For every prefix of ``y`` the length of its longest common subsequence with ``x``."""
    m = len(y)
    order = np.argsort(y, kind="stable")
    lines, starts = np.unique(y[order], return_index=True)
    places = dict(zip(lines.tolist(), np.split(order, starts[1:])))
    full = (1 << m) - 1
    row, masks, kept = full, {}, 0
    for line in x:
        at = places.get(line)
        if at is None:
            continue
        mask = masks.get(line)
        if mask is None:
            if len(at) == 1:
                mask = 1 << int(at[0])
            else:
                bits = np.zeros(m, np.uint8)
                bits[at] = 1
                mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if kept + m // 8 <= _KEPT_BYTES:
                masks[line] = mask
                kept += m // 8
        hit = row & mask
        if hit:
            row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((m + 7) // 8, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence, in order."""
    numbers: dict[str, int] = {}
    x = [numbers.setdefault(s, len(numbers)) for s in old]
    y = [numbers.setdefault(s, len(numbers)) for s in new]
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i1, i2, j1, j2 = todo.pop()
        while i1 < i2 and j1 < j2 and x[i1] == y[j1]:
            pairs.append((i1, j1))
            i1, j1 = i1 + 1, j1 + 1
        while i1 < i2 and j1 < j2 and x[i2 - 1] == y[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            pairs.append((i2, j2))
        if i1 == i2 or j1 == j2:
            continue
        # Lines that the other side lacks are in no common subsequence.
        left, right = set(x[i1:i2]), set(y[j1:j2])
        rows = [i for i in range(i1, i2) if x[i] in right]
        cols = [j for j in range(j1, j2) if y[j] in left]
        if not rows or not cols:
            continue
        if len(rows) == 1 or len(cols) == 1:
            i, j = (rows[0], next(j for j in cols if y[j] == x[rows[0]])) if len(rows) == 1 else (
                next(i for i in rows if x[i] == y[cols[0]]), cols[0]
            )
            pairs.append((i, j))
            continue
        half = len(rows) // 2
        inner = np.array([y[j] for j in cols])
        front = _row([x[i] for i in rows[:half]], inner)
        back = _row([x[i] for i in reversed(rows[half:])], inner[::-1])[::-1]
        cut = int(np.argmax(front + back))
        middle = cols[cut] if cut < len(cols) else j2
        todo.append((i1, rows[half], j1, middle))
        todo.append((rows[half], i2, middle, j2))
    return sorted(pairs)
