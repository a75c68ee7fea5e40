"""Alignment of two lists by longest common subsequence, and the list merge built on it.

Objects are cogrouped by key; each pair of lists is aligned by itself: common ends are cut off, then the longest equal run is taken (of
several the first in the left list, then in the right), and what lies before and after it is aligned alike. These are the stretches
of difflib.SequenceMatcher, which takes short ones; in long ones runs are found by hashes of all windows of a length, all runs of the
greatest length in one pass, so that the work follows the lists' length and not its square.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.errors import Code, StrataError
from strata.runtime import ship


SHORT = 192  # elements of both sides that SequenceMatcher is quicker for


def _hashes(codes: np.ndarray, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of hashed elements times falling powers of the multiplier, from the start; and the rising powers. Modulo 2**64."""
    n = len(codes)
    powers = np.ones(n + 1, np.uint64)
    done, step = 1, multiplier
    while done <= n:
        k = min(done, n + 1 - done)
        powers[done : done + k] = powers[:k] * np.uint64(step)
        step = step * step % 2**64
        done += k
    back = np.ones(n + 1, np.uint64)
    done, step = 1, pow(multiplier, -1, 2**64)
    while done <= n:
        k = min(done, n + 1 - done)
        back[done : done + k] = back[:k] * np.uint64(step)
        step = step * step % 2**64
        done += k
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * back[:n], dtype=np.uint64)]), powers


class _Runs:
    """Runs of equal elements of two long lists of codes."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        rng = np.random.default_rng(11)
        self.values = rng.integers(0, 2**63, int(max(a.max(), b.max())) + 1, dtype=np.uint64)
        self.multiplier = 0x9E3779B97F4A7C15
        self.sums_a, powers_a = _hashes(self.values[a], self.multiplier)
        self.sums_b, powers_b = _hashes(self.values[b], self.multiplier)
        self.powers = powers_a if len(powers_a) > len(powers_b) else powers_b

    def windows(self, sums: np.ndarray, lo: int, hi: int, k: int) -> np.ndarray:
        """The hashes of the windows of k elements that lie in [lo, hi)."""
        out = (sums[lo + k : hi + 1] - sums[lo : hi + 1 - k]) * self.powers[lo : hi + 1 - k]
        return out ^ (out >> np.uint64(31))

    def shared(self, at: tuple[int, int, int, int], k: int) -> bool:
        alo, ahi, blo, bhi = at
        return bool(pd.Series(self.windows(self.sums_a, alo, ahi, k)).isin(self.windows(self.sums_b, blo, bhi, k)).any())

    def longest(self, at: tuple[int, int, int, int], most: int) -> int:
        """The length of the longest run that both ranges hold, `most` at most; 0 if none."""
        low, high, step = 0, min(most, at[1] - at[0], at[3] - at[2]), 8
        while low < high:  # runs are short as a rule: go up by doubling, then halve
            k = min(high, low + step)
            if step and not self.shared(at, k):
                high, step = k - 1, 0
                break
            low, step = k, step * 2
        while low < high:
            k = (low + high + 1) // 2
            low, high = (k, high) if self.shared(at, k) else (low, k - 1)
        return low

    def chain(self, at: tuple[int, int, int, int], k: int) -> list[tuple[int, int]]:
        """Runs of k elements, the range's longest, one after the other: each the first of the left range, then of the right, after the one before."""
        alo, ahi, blo, bhi = at
        left, right = self.windows(self.sums_a, alo, ahi, k), self.windows(self.sums_b, blo, bhi, k)
        order = np.argsort(right, kind="stable")
        ranked = right[order]
        places = np.flatnonzero(pd.Series(left).isin(right).to_numpy())
        first, end = np.searchsorted(ranked, left[places]), np.searchsorted(ranked, left[places], "right")
        out, i, j, n = [], 0, 0, 0
        while n < len(places):
            if places[n] < i:
                n = int(np.searchsorted(places, i))
                continue
            f, e = first[n], end[n]
            g = f + np.searchsorted(order[f:e], j)
            if g < e:
                x, y = int(places[n]), int(order[g])
                if not np.array_equal(self.a[alo + x : alo + x + k], self.b[blo + y : blo + y + k]):
                    raise _Collision
                out.append((alo + x, blo + y))
                i, j = x + k, y + k
                if j > len(right) - 1:
                    break
            n += 1
        return out


class _Collision(Exception):
    """Two different windows of one hash."""


def matching_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """What SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() gives, adjacent blocks not yet joined and without the last."""
    if len(a) + len(b) <= SHORT or not a or not b:
        return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x[2]]
    seen: dict = {}
    code = lambda xs: np.fromiter((seen.setdefault(x, len(seen)) for x in xs), np.int64, len(xs))
    try:
        runs, out, todo = _Runs(code(a), code(b)), [], [(0, len(a), 0, len(b), min(len(a), len(b)))]
        while todo:
            alo, ahi, blo, bhi, most = todo.pop()
            if alo == ahi or blo == bhi:
                continue
            if ahi - alo + bhi - blo <= SHORT:
                sub = SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks()
                out += [(alo + x.a, blo + x.b, x.size) for x in sub if x.size]
                continue
            k = runs.longest((alo, ahi, blo, bhi), most)
            if not k:
                continue
            found = runs.chain((alo, ahi, blo, bhi), k)
            if not found:
                raise _Collision
            for x, y in found:
                out.append((x, y, k))
                todo.append((alo, x, blo, y, k - 1))
                alo, blo = x + k, y + k
            todo.append((alo, ahi, blo, bhi, k - 1))
        return sorted(out)
    except _Collision:  # by the odds never: 64 bits of hash
        return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x[2]]


def _steps(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """The opcodes between two lists: SequenceMatcher's."""
    out, i, j, blocks = [], 0, 0, []
    for x, y, k in matching_blocks(a, b):
        if blocks and (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]) == (x, y):
            blocks[-1] = (blocks[-1][0], blocks[-1][1], blocks[-1][2] + k)
        else:
            blocks.append((x, y, k))
    for x, y, k in [*blocks, (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j = x + k, y + k
        if k:
            out.append(("equal", x, i, y, j))
    return out


def opcodes(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    mid_a, mid_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    out = [("equal", 0, lo, 0, lo)] if lo else []
    out += [(t, i + lo, j + lo, k + lo, m + lo) for t, i, j, k, m in _steps(mid_a, mid_b)]
    if hi:
        out.append(("equal", len(a) - hi, len(a), len(b) - hi, len(b)))
    return out


def edits(base: list, new: list) -> list[tuple[int, int, list]]:
    """(start, end, elements): stretches of base and what takes their place."""
    return [(i, j, new[k:m]) for t, i, j, k, m in opcodes(base, new) if t != "equal"]


def merge_lists(base: list, a: list, b: list) -> list:
    """Both sides' edits of base; equal edits once; overlapping different ones are a conflict. Insertions at one place: a's, then b's."""
    ea, eb = edits(base, a), edits(base, b)
    theirs = [e for e in eb if e not in ea]
    for i, j, _ in ea:
        for k, m, _ in theirs:
            if (i < m and k < j) or (i == j and k < i < m) or (k == m and i < k < j):
                raise StrataError(Code.MERGE_CONFLICT, f"[{i}, {j}) and [{k}, {m})")
    out = list(base)
    order = sorted([(i, j, 0, x) for i, j, x in ea] + [(i, j, 1, x) for i, j, x in theirs], key=lambda e: (e[0], e[1], e[2]))
    for i, j, _, x in reversed(order):
        out[i:j] = x
    return out


def align(lhs: DataFrame, rhs: DataFrame, key: str, idx: str = "_rid", value: str = "value") -> DataFrame:
    """key, lhs_first, lhs_n, rhs_first, rhs_n, op of each stretch. lhs, rhs: (key, idx, value), one list per key."""
    ship(lhs.sparkSession)
    schema = f"{key} {dict(lhs.dtypes)[key]}, op string, lhs_first long, lhs_n long, rhs_first long, rhs_n long"

    def run(k, a, b):
        rows = [(k[0], t, i, j - i, m, n - m) for t, i, j, m, n in opcodes(_values(a, idx, value), _values(b, "_i", "_v"))]
        return pd.DataFrame(rows, columns=[key, "op", "lhs_first", "lhs_n", "rhs_first", "rhs_n"])

    # columns of their own on the right: where both sides come from one table, Spark would leave out columns that they share
    right = rhs.select(F.col(key).alias("_k"), F.col(idx).alias("_i"), F.col(value).alias("_v"))
    return lhs.select(key, idx, value).groupBy(key).cogroup(right.groupBy("_k")).applyInPandas(run, schema)


def _values(f: pd.DataFrame, idx: str, value: str) -> list:
    """The list of a group in order; a list that one side lacks is empty."""
    return f.sort_values(idx)[value].tolist() if len(f) else []


def merge3(base: DataFrame, a: DataFrame, b: DataFrame, key: str, idx: str = "_rid", value: str = "value") -> DataFrame:
    """Three-way merge of lists: key, idx, value. Each input (key, idx, value), one list per key; a conflict is an error.

    One task a list: an alignment looks at both lists as wholes. Many lists are merged side by side.
    """
    ship(base.sparkSession)
    kinds = dict(base.dtypes)
    sides = [d.select(key, idx, value, F.lit(n).alias("_side")) for n, d in enumerate((base, a, b))]

    def run(k, rows):
        own = [rows[rows["_side"] == n].sort_values(idx)[value].tolist() for n in range(3)]
        out = merge_lists(*own)
        return pd.DataFrame({key: [k[0]] * len(out), idx: range(len(out)), value: out})

    both = sides[0].unionByName(sides[1]).unionByName(sides[2])
    return both.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {idx} long, {value} {kinds[value]}")
