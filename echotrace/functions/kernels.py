"""NumPy kernels for pairs of token sequences, and their Arrow functions.

Rows of a dynamic programme are computed as whole vectors: what depends on the left neighbour becomes a running maximum or
minimum.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences as numbers, equal where the elements are."""
    place: dict = {}
    both = [place.setdefault(x, len(place)) for x in [*a, *b]]
    return np.array(both[: len(a)], dtype=np.int64), np.array(both[len(a) :], dtype=np.int64)


def lcs_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of all prefixes."""
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i, x in enumerate(a):
        table[i + 1, 1:] = np.maximum.accumulate(np.where(b == x, table[i, :-1] + 1, table[i, 1:]))
    return table


def _lcs_rows(a: np.ndarray, b: np.ndarray, row: int) -> Iterator[int]:
    """Rows of the table as numbers, from `row` on, which stands before a's first element: bit j is set where the table doesn't rise from column j to j + 1.

    An addition moves the lowest match of each run of set bits up to the run's end: Python's integers do that for all words of a row
    with the carry between them.
    """
    places: dict[int, int] = {}
    for j, y in enumerate(b.tolist()):
        places[y] = places.get(y, 0) | 1 << j
    whole = (1 << len(b)) - 1
    for x in a.tolist():
        found = row & places.get(x, 0)
        if found:
            row = ((row + found) | (row - found)) & whole
        yield row


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    row = (1 << len(b)) - 1
    for row in _lcs_rows(a, b, row):
        pass
    return len(b) - row.bit_count()


#: Bits of a table that lcs_positions holds at once; larger pairs keep the table's rows at intervals and work out the others again.
_CELLS = 800_000_000


def lcs_positions(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """One longest common subsequence, from the end: an equal pair is taken, else a's end is given up unless that loses more."""
    first, width = (1 << len(b)) - 1, len(b) + 1
    step = max(1, min(len(a), _CELLS // width))
    # Every step-th row of the table; the rows between two of them are made when the walk comes there.
    rows = [first]
    if step < len(a):
        rows += [row for i, row in enumerate(_lcs_rows(a, b, first), 1) if i % step == 0]
    found, j, x, y, length = [], len(b), a.tolist(), b.tolist(), None
    for k in range((len(a) - 1) // step, -1, -1):
        begin = k * step
        part = [rows[k], *_lcs_rows(a[begin : begin + step], b, rows[k])]
        if length is None:
            length = j - part[-1].bit_count()
        i = begin + len(part) - 1
        while i > begin and j and length:
            if x[i - 1] == y[j - 1]:
                i, j, length = i - 1, j - 1, length - 1
                found.append((i, j))
            elif j - (part[i - begin - 1] & ((1 << j) - 1)).bit_count() < length:
                j -= 1
            else:
                i -= 1
    return found[::-1]


def osa_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Optimal string alignment: insert, delete, replace, swap of neighbours; no part is edited twice."""
    index = np.arange(len(b) + 1)
    before, row = None, index.copy()
    for i, x in enumerate(a):
        cost = (b != x).astype(np.int64)
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + cost)
        if before is not None and len(b) > 1:
            swap = (b[:-1] == x) & (b[1:] == a[i - 1])
            new[2:] = np.where(swap, np.minimum(new[2:], before[:-2] + cost[1:]), new[2:])
        before, row = row, np.minimum.accumulate(new - index) + index
    return int(row[-1])


def common_runs(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Rows (length, end in a, end in b) of all common runs of at least `least`, each prefix of a run on its own, ordered by ends."""
    row, found = np.zeros(len(b) + 1, dtype=np.int64), []
    for i, x in enumerate(a):
        new = np.zeros_like(row)
        new[1:] = np.where(b == x, row[:-1] + 1, 0)
        at = np.flatnonzero(new >= least)
        if len(at):
            found.append(np.stack([new[at], np.full(len(at), i + 1), at], axis=1))
        row = new
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def run_ends(a: np.ndarray, b: np.ndarray, least: int, low: int = 0, high: int = 1 << 31) -> Iterator[np.ndarray]:
    """Rows (length, end in a, end in b) of the common runs that can't be made longer, of at least `least` and from low to high; one row of the table is held."""
    row, low = np.zeros(len(b) + 1, dtype=np.int32), max(least, low)
    for i in range(len(a) + 1):
        same = b == a[i] if i < len(a) else np.zeros(len(b), dtype=bool)
        ended = np.flatnonzero((row >= low) & (row <= high) & ~np.append(same, False))
        if len(ended):
            yield np.stack([row[ended], np.full(len(ended), i, dtype=np.int32), ended.astype(np.int32)], axis=1)
        row[1:] = np.where(same, row[:-1] + 1, 0)
        row[0] = 0


class Squares:
    """Disjoint squares of a table, kept by the tiles of the table that they meet."""

    def __init__(self, tile: int = 128):
        self.tile, self.tiles = tile, {}

    def _met(self, n: int, begin1: int, begin2: int) -> Iterator[tuple[int, int]]:
        for k in range(begin1 // self.tile, (begin1 + n - 1) // self.tile + 1):
            for l2 in range(begin2 // self.tile, (begin2 + n - 1) // self.tile + 1):
                yield k, l2

    def add(self, n: int, end1: int, end2: int) -> None:
        for tile in self._met(n, end1 - n, end2 - n):
            held, used = self.tiles.get(tile, (np.empty((4, 4), dtype=np.int32), 0))
            if used == len(held):
                held = np.concatenate([held, np.empty_like(held)])
            held[used] = (end1 - n, end1, end2 - n, end2)
            self.tiles[tile] = (held, used + 1)

    def room(self, n: int, end1: int, end2: int) -> int:
        """The most elements from the square's first cell on that meet no other square: n if it is free."""
        begin1, begin2 = end1 - n, end2 - n
        for tile in self._met(n, begin1, begin2):
            if tile in self.tiles:
                held, used = self.tiles[tile]
                r = held[:used]
                meets = r[(r[:, 0] < begin1 + n) & (r[:, 1] > begin1) & (r[:, 2] < begin2 + n) & (r[:, 3] > begin2)]
                if len(meets):
                    n = max(0, int(np.maximum(meets[:, 0] - begin1, meets[:, 2] - begin2).min()))
                    if not n:
                        break
        return n


#: Runs that disjoint_matches holds at once; more of them are taken up in bands of lengths.
_RUNS = 2_000_000


def disjoint_matches(a: np.ndarray, b: np.ndarray, least: int = 2) -> list[tuple[int, int, int, int, int]]:
    """Common substrings (length, start1, end1, start2, end2), longest first, none meeting another in both sequences.

    Ties go to the smaller end in a, then in b. A run that meets one before it comes again with as many of its first elements as are
    free, in the place that this length has; so only runs that can't be made longer are listed, and no table is kept.
    """
    sizes = np.zeros(min(len(a), len(b)) + 1, dtype=np.int64)
    for some in run_ends(a, b, least):
        sizes += np.bincount(some[:, 0], minlength=len(sizes))
    taken, out, shorter = Squares(), [], []
    high = len(sizes) - 1
    while high >= least:
        total, low = sizes[high], high
        while low > least and total + sizes[low - 1] <= _RUNS:
            low -= 1
            total += sizes[low]
        runs = np.concatenate([np.zeros((0, 3), dtype=np.int32), *run_ends(a, b, least, low, high)]) if total else np.zeros((0, 3), dtype=np.int32)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], -runs[:, 0]))]
        at = 0
        while at < len(runs) or (shorter and -shorter[0][0] >= low):
            run = (-int(runs[at, 0]), int(runs[at, 1]), int(runs[at, 2])) if at < len(runs) else None
            if run is None or (shorter and shorter[0] < run):
                run = heapq.heappop(shorter)
            else:
                at += 1
            n, end1, end2 = -run[0], run[1], run[2]
            free = taken.room(n, end1, end2)
            if free == n:
                taken.add(n, end1, end2)
                out.append((n, end1 - n, end1, end2 - n, end2))
            elif free >= least:
                heapq.heappush(shorter, (-free, end1 - n + free, end2 - n + free))
        high = low - 1
    return out


#: Equal cells that are looked at together for starts of matches with edits.
_SEEDS = 4_000_000


def relaxed_starts(a: np.ndarray, b: np.ndarray, smallest: int, k: int) -> np.ndarray:
    """Pairs of starts (rows of two columns, in order) whose windows of `smallest` elements may be at most k edits apart.

    Of the first `smallest` elements of a window all but k equal one of the other's that lies at most k places off its diagonal:
    insertions cost none, deletions and replacements one each, and both elements of a swap have their equal one place beside. Only
    equal cells are listed, and for each diagonal the rows that have one in its band are counted between two searches.
    """
    m, n = len(a), len(b)
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    upto = np.concatenate(([0], np.cumsum(high - low)))
    stride, found, begin = m + smallest + 1, [], 0
    while begin <= m - smallest:
        end = min(m - smallest + 1, max(begin + 1, int(np.searchsorted(upto, upto[begin] + _SEEDS)) - smallest))
        rows = np.arange(begin, end + smallest - 1)
        count = (high - low)[rows]
        p = np.repeat(rows, count)
        q = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[rows], count)]
        band = np.unique(((q - p + m + k)[:, None] + np.arange(-k, k + 1)).ravel() * stride + np.repeat(p, 2 * k + 1))
        first = np.unique((band[:, None] - np.arange(k + 1)).ravel())
        within = np.searchsorted(band, first + smallest) - np.searchsorted(band, first)
        i, diagonal = first % stride, first // stride - m - k
        ok = (within >= smallest - k) & (i >= begin) & (i < end) & (i + diagonal >= 0) & (i + diagonal <= n - smallest)
        found.append(np.stack([i[ok], (i + diagonal)[ok]], axis=1))
        begin = end
    pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _relaxed_windows(a: np.ndarray, b: np.ndarray, starts: np.ndarray, smallest: int, k: int) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """(numbers of starts, size in a, size in b, edits) of the windows at most k edits apart, the sizes of a start ascending.

    Windows are compared by optimal string alignment in a band of k around the diagonal. A pair of starts shares one table for all
    its windows, all pairs of starts advance row by row together, and those whose band has risen over k drop out. A
    pair with edits whose main diagonal has exactly one run of equal tokens is no match.
    """
    m, n = len(a), len(b)
    number, i0, j0 = np.arange(len(starts)), starts[:, 0], starts[:, 1]
    shift = np.arange(-k, k + 1)
    first = np.where(shift >= 0, shift, k + 1)
    history = [np.tile(first, (len(i0), 1))]  # the last rows; column d of row r is cell (r, r + shift[d])
    sections, inside = np.zeros(len(i0), dtype=np.int64), np.zeros(len(i0), dtype=bool)
    r = 0
    while len(i0):
        r += 1
        goes_on = i0 + r <= m
        number, i0, j0, sections, inside = number[goes_on], i0[goes_on], j0[goes_on], sections[goes_on], inside[goes_on]
        history = [h[goes_on] for h in history[-(2 * k + 3) :]]
        if not len(i0):
            break
        col = r + shift
        exists = (col[None, :] >= 1) & (j0[:, None] + col[None, :] <= n)
        x = a[i0 + r - 1]
        y = b[np.clip(j0[:, None] + col[None, :] - 1, 0, n - 1)]
        equal = (y == x[:, None]) & exists
        up, far = history[-1], k + 1
        row = np.full((len(i0), 2 * k + 1), far, dtype=np.int64)
        if r <= k:
            row[:, k - r] = r  # column 0
        swap = np.zeros_like(equal)
        if r > 1:
            x2 = a[i0 + r - 2]
            y2 = b[np.clip(j0[:, None] + col[None, :] - 2, 0, n - 1)]
            swap = (x[:, None] == y2) & (x2[:, None] == y) & (col[None, :] > 1) & exists
        for d in range(2 * k + 1):
            above = up[:, d + 1] if d < 2 * k else np.full(len(i0), far)
            left = row[:, d - 1] if d else np.full(len(i0), far)
            cell = np.minimum(np.minimum(above, left), up[:, d]) + 1
            if r > 1:
                cell = np.where(swap[:, d], np.minimum(cell, history[-2][:, d] + 1), cell)
            cell = np.where(equal[:, d], up[:, d], cell)
            row[:, d] = np.where(exists[:, d], cell, row[:, d])
        history.append(row)
        on_diagonal = exists[:, k]
        begins = on_diagonal & equal[:, k] & ~inside
        sections = sections + begins
        inside = np.where(on_diagonal, equal[:, k], inside)
        # Windows that end in this row: r of a and r of b, or one of them cut at its end.
        for l2 in range(max(smallest, r - k), r + k + 1):
            ends1, ends2 = i0 + r == m, j0 + l2 == n
            ok = (j0 + l2 <= n) & (r >= smallest)
            ok &= (l2 == r) | ((l2 > r) & ends1) | ((l2 < r) & ends2)
            if not ok.any():
                continue
            edits = row[:, l2 - r + k]
            for back in range(len(history) - 1):
                q = r - back  # rows whose band is cut by l2
                if q < 1 or q + k <= l2:
                    break
                seen = (q + shift >= 1) & (q + shift <= l2)
                ok &= np.where(seen[None, :], history[-1 - back], far).min(axis=1) <= k
            ok &= (edits <= k) & ~((sections == 1) & (edits > 0))
            if ok.any():
                yield number[ok], r, l2, edits[ok]
        alive = np.where(exists, row, far).min(axis=1) <= k
        number, i0, j0, sections, inside = number[alive], i0[alive], j0[alive], sections[alive], inside[alive]
        history = [h[alive] for h in history]


Span = tuple[int, int, int, int, int, int]


def relaxed_spans(a: np.ndarray, b: np.ndarray, min_consecutive: int = 3, max_edits: int = 1) -> list[Span]:
    """All pairs of spans (length, edits, start1, end1, start2, end2) at most max_edits apart, in order of window size and starts.

    Windows of each size from min_consecutive + max_edits + 1 on are cut at the ends of the sequences.
    """
    smallest, found = min_consecutive + max_edits + 1, []
    if min(len(a), len(b)) < smallest:
        return []
    starts = relaxed_starts(a, b, smallest, max_edits)
    for number, r, l2, edits in _relaxed_windows(a, b, starts, smallest, max_edits):
        for (i, j), e in zip(starts[number].tolist(), edits.tolist(), strict=True):
            found.append((max(r, l2), e, i, i + r, j, j + l2))
    return sorted(found, key=lambda f: (f[0], f[2], f[4], f[3], f[5]))


def relaxed_longest(a: np.ndarray, b: np.ndarray, min_consecutive: int = 3, max_edits: int = 1) -> list[Span]:
    """The spans that no longer one with no more edits contains, longest first.

    Windows of one pair of starts lie in each other, so of each only the longest for every number of edits is kept on the way, at most
    max_edits + 1 of a pair of starts however long they are.
    """
    smallest, k = min_consecutive + max_edits + 1, max_edits
    if min(len(a), len(b)) < smallest:
        return []
    starts = relaxed_starts(a, b, smallest, k)
    sizes = np.zeros((len(starts), k + 1, 2), dtype=np.int64)
    for number, r, l2, edits in _relaxed_windows(a, b, starts, smallest, k):
        sizes[number, edits] = (r, l2)
        for e in range(1, k + 1):
            sizes[number[edits < e], e] = 0  # a longer one with fewer edits
    at, edits = np.nonzero(sizes[:, :, 0])
    (i, j), (r, l2) = starts[at].T, sizes[at, edits].T
    rows = np.stack([np.maximum(r, l2), edits, i, i + r, j, j + l2], axis=1)
    return uncontained(rows[np.lexsort((rows[:, 5], rows[:, 3], rows[:, 4], rows[:, 2], rows[:, 0]))])


class Frontier:
    """Spans met so far in order of their first starts (of one start: longest first), without those that another one makes needless."""

    def __init__(self):
        #: start2, -end1, -end2, edits, -length and order: a span covers another if it has no larger one of the first four and comes before it.
        self.held, self.used = np.empty((64, 6), dtype=np.int64), 0

    def admits(self, start1: int, end1: int, start2: int, end2: int, edits: int, length: int, order: int) -> bool:
        """Whether no span before covers this one; it is then held."""
        own = np.array([start2, -end1, -end2, edits, -length, order])
        rows = self.held[: self.used]
        before = (rows[:, 4] < -length) | ((rows[:, 4] == -length) & (rows[:, 5] < order))
        if (before & (rows[:, :4] <= own[:4]).all(axis=1)).any():
            return False
        if self.used == len(self.held):
            # Spans that ended before this start, or that this one covers and comes before, are of no more use.
            kept = rows[(rows[:, 1] <= -start1) & (before | ~(rows[:, :4] >= own[:4]).all(axis=1))]
            size = len(self.held) * (2 if 2 * len(kept) > len(self.held) else 1)
            self.held, self.used = np.empty((size, 6), dtype=np.int64), len(kept)
            self.held[: self.used] = kept
        self.held[self.used] = own
        self.used += 1
        return True


def uncontained(spans: list[Span] | np.ndarray) -> list[Span]:
    """Longest first, without those that one before them contains in both sequences with no more edits.

    That relation is transitive, so it doesn't matter whether the one before was itself kept. One sweep over the first starts.
    """
    rows = np.array(spans, dtype=np.int64).reshape(-1, 6)
    rows = rows[np.argsort(-rows[:, 0], kind="stable")]
    keep, frontier = np.zeros(len(rows), dtype=bool), Frontier()
    for at in np.argsort(rows[:, 2], kind="stable").tolist():
        n, edits, s1, e1, s2, e2 = rows[at].tolist()
        keep[at] = frontier.admits(s1, e1, s2, e2, edits, n, at)
    return [tuple(r) for r in rows[keep].tolist()]


def banded_table(a: np.ndarray, b: np.ndarray, max_edits: int) -> np.ndarray:
    """The whole alignment table with max_edits + 1 outside the band of max_edits around the diagonal; for looking at one pair.

    Inside, equal ends take the diagonal cell; others cost one edit from a neighbour, or from before a swap of two.
    """
    m, n, far = len(a), len(b), max_edits + 1
    table = np.full((m + 1, n + 1), far, dtype=np.int32)
    table[: max_edits + 1, 0] = np.arange(min(m, max_edits) + 1)
    table[0, : max_edits + 1] = np.arange(min(n, max_edits) + 1)
    # Cells on one antidiagonal depend on earlier ones only, so each is worked out as a vector.
    for total in range(2, m + n + 1):
        i = np.arange(max(1, total - n), min(m, total - 1) + 1)
        i = i[np.abs(total - 2 * i) <= max_edits]
        j = total - i
        if not len(i):
            continue
        least = np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]), table[i - 1, j - 1]) + 1
        two = np.flatnonzero((i > 1) & (j > 1))
        p, q = i[two], j[two]
        swap = two[(a[p - 1] == b[q - 2]) & (a[p - 2] == b[q - 1])]
        least[swap] = np.minimum(least[swap], table[i[swap] - 2, j[swap] - 2] + 1)
        table[i, j] = np.where(a[i - 1] == b[j - 1], table[i - 1, j - 1], least)
    return table


def longest_common_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """length, start1, end1, start2, end2 of the longest common run, the first by ends; zeros if there is none. Keeps one row."""
    row, best = np.zeros(len(b) + 1, dtype=np.int64), (0, 0, 0)
    for i, x in enumerate(a):
        row[1:] = np.where(b == x, row[:-1] + 1, 0)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    n, e1, e2 = best
    return (n, e1 - n, e1, e2 - n, e2)


def longest_common_substrings(reference, predicted):
    """One result (a dict) for two sequences, a list of results for two lists of sequences; errors where the shapes don't fit."""
    nested = [len(x) > 0 and isinstance(x[0], (list, tuple, np.ndarray)) for x in (reference, predicted)]
    if nested[0] != nested[1]:
        raise ValueError("both must be sequences or both lists of sequences")
    if not nested[0]:
        names = ("length", "start1", "end1", "start2", "end2")
        return dict(zip(names, longest_common_run(*codes(list(reference), list(predicted))), strict=True))
    if any(len(x) > 0 and isinstance(x[0], (list, tuple, np.ndarray)) for side in (reference, predicted) for x in side):
        raise ValueError("sequences must have one dimension")
    if len(reference) != len(predicted):
        raise ValueError(f"{len(reference)} references and {len(predicted)} predictions")
    return [longest_common_substrings(x, y) for x, y in zip(reference, predicted, strict=True)]


def _diagonal_runs(a: np.ndarray, b: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Rows (start in a, start in b, length) of runs of equal elements that are allowed in b; only equal cells are listed."""
    at = np.flatnonzero(allowed)
    order = at[np.argsort(b[at], kind="stable")]
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    count = high - low
    i = np.repeat(np.arange(len(a)), count)
    j = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    begins = np.ones(len(i), dtype=bool)
    begins[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    first = np.flatnonzero(begins)
    return np.stack([i[first], j[first], np.diff(np.append(first, len(i)))], axis=1)


def matching_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of a diff's equal parts: the longest common run, the first one of several, then the same to its left and right.

    Of 200 elements or more, those that are over one in a hundred of b are no part of the search; a run found grows by them afterwards.
    """
    allowed = np.ones(len(b), dtype=bool)
    if len(b) >= 200:
        _, inverse, count = np.unique(b, return_inverse=True, return_counts=True)
        allowed = count[inverse] <= len(b) // 100 + 1
    found, parts = [], [(0, len(a), 0, len(b), _diagonal_runs(a, b, allowed))]
    while parts:
        alo, ahi, blo, bhi, runs = parts.pop()
        # The runs as far as they lie in this part of the table.
        ahead = np.maximum(0, np.maximum(alo - runs[:, 0], blo - runs[:, 1]))
        i, j = runs[:, 0] + ahead, runs[:, 1] + ahead
        n = np.minimum(runs[:, 2] - ahead, np.minimum(ahi - i, bhi - j))
        inside = n > 0
        runs = np.stack([i[inside], j[inside], n[inside]], axis=1)
        # Without a run the part's beginning may still be equal, in elements that aren't searched for.
        x, y, size = runs[np.lexsort((runs[:, 1], runs[:, 0], -runs[:, 2]))[0]].tolist() if len(runs) else (alo, blo, 0)
        begin, end = (x, y), (x + size, y + size)
        while begin[0] > alo and begin[1] > blo and a[begin[0] - 1] == b[begin[1] - 1]:
            begin = (begin[0] - 1, begin[1] - 1)
        while end[0] < ahi and end[1] < bhi and a[end[0]] == b[end[1]]:
            end = (end[0] + 1, end[1] + 1)
        if end == begin:
            continue
        found.append((*begin, end[0] - begin[0]))
        parts += [(alo, begin[0], blo, begin[1], runs), (end[0], ahi, end[1], bhi, runs)]
    return sorted(found)


def opcodes(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """The steps (equal, replace, delete, insert; spans of a and b) that make b of a. Parts that follow each other without a gap are one."""
    x, y = codes(a, b)
    joined: list[list[int]] = []
    for i, j, n in matching_blocks(x, y):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1][2] += n
        else:
            joined.append([i, j, n])
    steps, at = [], (0, 0)
    for i, j, n in [*joined, [len(x), len(y), 0]]:
        if (i, j) != at:
            tag = "replace" if i > at[0] and j > at[1] else "delete" if i > at[0] else "insert"
            steps.append((tag, at[0], i, at[1], j))
        if n:
            steps.append(("equal", i, i + n, j, j + n))
        at = (i + n, j + n)
    return steps


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    value = d
    for i in range(1, 400):
        for top in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs, by Student's distribution with n - 2 degrees of freedom."""
    if n < 3 or r is None or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return beta_share(df / 2, 0.5, df / (df + t2))


def _rows(names: str) -> T.ArrayType:
    """An array of structs of integers; a field named tag is a string."""
    row = T.StructType()
    for name in names.split():
        row = row.add(name, "string" if name == "tag" else "integer")
    return T.ArrayType(row)


def _pairs(a: pd.Series, b: pd.Series):
    for x, y in zip(a, b, strict=True):
        yield (np.zeros(0, dtype=np.int64),) * 2 if x is None or y is None else codes(x, y)


@F.pandas_udf(T.IntegerType())
def lcs_length_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in _pairs(a, b)])


@F.pandas_udf(_rows("pos1 pos2"))
def lcs_positions_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"pos1": i, "pos2": j} for i, j in lcs_positions(x, y)] for x, y in _pairs(a, b)])


def osa_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of many pairs of sequences of one length each (rows of a and b): the recurrence over all rows at once."""
    index = np.arange(b.shape[1] + 1)
    before, row = None, np.tile(index, (len(b), 1))
    for i in range(a.shape[1]):
        x = a[:, i : i + 1]
        cost = (b != x).astype(np.int64)
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + cost)
        if before is not None and b.shape[1] > 1:
            swap = (b[:, :-1] == x) & (b[:, 1:] == a[:, i - 1 : i])
            new[:, 2:] = np.where(swap, np.minimum(new[:, 2:], before[:, :-2] + cost[:, 1:]), new[:, 2:])
        before, row = row, np.minimum.accumulate(new - index, axis=1) + index
    return row[:, -1]


def osa_of_pairs(a: pd.Series, b: pd.Series) -> np.ndarray:
    """The distance of each pair; pairs with the same two lengths are worked out together, and elements are numbered once for all."""
    place: dict = {}
    number = lambda s: np.array([place.setdefault(x, len(place)) for x in s], dtype=np.int64)
    pairs = [(number(x), number(y)) if x is not None and y is not None else (number([]), number([])) for x, y in zip(a, b, strict=True)]
    out, by_size = np.zeros(len(pairs), dtype=np.int64), {}
    for i, (x, y) in enumerate(pairs):
        by_size.setdefault((len(x), len(y)), []).append(i)
    for rows in by_size.values():
        for at in range(0, len(rows), 8192):
            some = rows[at : at + 8192]
            out[some] = osa_distances(*(np.stack([pairs[i][side] for i in some]) for side in (0, 1)))
    return out


@F.pandas_udf(T.IntegerType())
def osa_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(osa_of_pairs(a, b))


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("length", "start1", "end1", "start2", "end2")]))
def longest_run_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([longest_common_run(x, y) for x, y in _pairs(a, b)], columns=["length", "start1", "end1", "start2", "end2"])


@F.pandas_udf(_rows("length start1 end1 start2 end2"))
def disjoint_matches_udf(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    names = ("length", "start1", "end1", "start2", "end2")
    return pd.Series(
        [[dict(zip(names, t, strict=True)) for t in disjoint_matches(x, y, int(k))] for (x, y), k in zip(_pairs(a, b), least, strict=True)]
    )


def _relaxed(a: pd.Series, b: pd.Series, min_consecutive: pd.Series, max_edits: pd.Series, find) -> pd.Series:
    names = ("length", "edits", "start1", "end1", "start2", "end2")
    rows = zip(_pairs(a, b), min_consecutive, max_edits, strict=True)
    return pd.Series([[dict(zip(names, t, strict=True)) for t in find(x, y, int(c), int(e))] for (x, y), c, e in rows])


@F.pandas_udf(_rows("length edits start1 end1 start2 end2"))
def relaxed_spans_udf(a: pd.Series, b: pd.Series, min_consecutive: pd.Series, max_edits: pd.Series) -> pd.Series:
    return _relaxed(a, b, min_consecutive, max_edits, relaxed_spans)


@F.pandas_udf(_rows("length edits start1 end1 start2 end2"))
def relaxed_matches_udf(a: pd.Series, b: pd.Series, min_consecutive: pd.Series, max_edits: pd.Series) -> pd.Series:
    return _relaxed(a, b, min_consecutive, max_edits, relaxed_longest)


@F.pandas_udf(_rows("tag start1 end1 start2 end2"))
def opcodes_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    names = ("tag", "start1", "end1", "start2", "end2")
    return pd.Series([[dict(zip(names, t, strict=True)) for t in opcodes(list(x), list(y))] for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def correlation_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(x, int(k)) for x, k in zip(r, n, strict=True)])
