"""Edit distances by Myers' bit-parallel recurrence, on integers of any width."""

from __future__ import annotations

import numpy as np


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of the positions where it stands."""
    found: dict[str, int] = {}
    for at, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << at
    return found


def _columns(positions: dict[str, int], length: int, text: str, whole: bool):
    """Distance of the pattern to what ends at each character of the text.

    ``whole``: to the text so far; otherwise to the best of its ends, from any start.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score, carry = full, 0, length, int(whole)
    for c in text:
        same = positions.get(c, 0)
        vertical = same | down
        diagonal = (((same & up) + up) ^ up) | same
        plus = down | (~(diagonal | up) & full)
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | carry) & full
        minus = minus << 1 & full
        up = minus | (~(vertical | plus) & full)
        down = plus & vertical
        yield score


def best_end(positions: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least distance of the pattern to any part of the text, and where that part ends."""
    best, end = length, 0
    for at, score in enumerate(_columns(positions, length, text, False), 1):
        if score < best:
            best, end = score, at
    return best, end


def within(a: str, b: str, budget: int) -> bool:
    """Whether the Levenshtein distance is at most ``budget``."""
    if not a or not b:
        return len(a) + len(b) <= budget
    left = len(b)
    for score in _columns(masks(a), len(a), b, True):
        left -= 1
        if score - left > budget:  # each character left can take off one at most
            return False
    return score <= budget


def distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    if not a or not b:
        return len(a) + len(b)
    score = len(a)
    for score in _columns(masks(a), len(a), b, True):
        pass
    return score


#: Buckets that pairs of neighbouring characters are counted in.
PROFILE = 512


def profile(text: str) -> np.ndarray:
    """Counts of pairs of neighbouring characters, hashed to ``PROFILE`` buckets."""
    codes = _codes(text)
    return np.bincount((codes[:-1] * 31 + codes[1:]) % PROFILE, minlength=PROFILE)


#: Length of the character n-grams that tell texts apart which pairs do not, and their buckets.
GRAM, BUCKETS = 5, 1 << 12


def gram_profile(codes: np.ndarray) -> np.ndarray:
    """Counts of the ``GRAM``-grams of characters, hashed to ``BUCKETS`` buckets."""
    value = np.zeros(max(len(codes) - GRAM + 1, 0), np.int64)
    for k in range(GRAM):
        value = value * 31 + codes[k : k + len(value)]
    return np.bincount((value ^ value >> 12) % BUCKETS, minlength=BUCKETS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def budget_of(longer: int, least: float) -> int:
    """Errors that a similarity of ``least`` allows the longer text."""
    return int((1 - least) * longer + 1e-9)


def similar(a: str, b: str, least: float) -> bool:
    """Whether the distance is at most ``1 - least`` of the longer text.

    An edit changes at most n of the n-grams on either side, so texts whose profiles of pairs
    differ by more than four times the budget, or of ``GRAM``-grams by more than ten times,
    are not compared.
    """
    if a == b:
        return True
    budget = budget_of(max(len(a), len(b)), least)
    if abs(len(a) - len(b)) > budget:
        return False
    if np.abs(profile(a) - profile(b)).sum() > 4 * budget:
        return False
    grams = gram_profile(_codes(a)) - gram_profile(_codes(b))
    if np.abs(grams).sum() > 2 * GRAM * budget:
        return False
    start = 0
    for x, y in zip(a, b):  # a common start or end needs no comparison
        if x != y:
            break
        start += 1
    a, b = a[start:], b[start:]
    end = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    return within(a, b, budget)


#: Numbers that the tables of pairs compared side by side may take; so few pairs, or pairs of so
#: large budgets, are compared one by one.
TABLE, FEW, MOST = 1 << 21, 12, 200


def similar_many(a: list[str], b: list[str], least: float) -> np.ndarray:
    """:func:`similar` of many pairs."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    budget = np.array([budget_of(int(m), least) for m in sizes.max(1)], np.int64)
    found = np.array([x == y for x, y in zip(a, b)], bool)
    left = np.flatnonzero(~found & (np.abs(sizes[:, 0] - sizes[:, 1]) <= budget) & (budget > 0))
    # the band of a budget has to lie within the text
    alone = (budget[left] * 4 > sizes[left].min(1)) | (budget[left] > MOST)
    for i in left[alone]:
        found[i] = similar(a[i], b[i], least)
    left = left[~alone]
    left = left[np.argsort(budget[left], kind="stable")]
    while len(left):
        # as many pairs as have like budgets, and room for 32 characters each
        room = np.arange(1, len(left) + 1) * (sizes[left].max(1) + 4 * budget[left] + 256) // 2
        count = int(min(np.searchsorted(room, TABLE), np.searchsorted(budget[left], 2 * budget[left[0]] + 1)))
        some, left = left[: max(count, 1)], left[max(count, 1) :]
        if len(some) > FEW:
            _within_many(a, b, some, sizes, budget, found)
        else:
            found[some] = [similar(a[i], b[i], least) for i in some]
    return found


def _within_many(a, b, rows: np.ndarray, sizes: np.ndarray, budget: np.ndarray, found: np.ndarray) -> None:
    """Set ``found`` for those of ``rows`` whose distance is at most their ``budget``.

    Hyyroe's banded form of Myers' recurrence: only cells at most the largest budget off the
    diagonal are kept, as bits of a few numbers for each pair, and all pairs take a step at once.
    """
    rows = rows[np.argsort(-sizes[rows, 1], kind="stable")]  # pairs that have ended are the last ones
    n, k = len(rows), int(budget[rows].max())
    width = -(-(2 * k + 2) // 64)  # numbers of a band
    m, o = sizes[rows, 0], sizes[rows, 1]
    pattern, text = (_codes("".join(side[i] for i in rows)) for side in (a, b))
    values = np.unique(np.concatenate([np.unique(pattern), np.unique(text)]))
    # numbers of a pattern, with empty ones before and behind it
    long = int(max(m.max() + k, o.max() + k)) // 64 + 2 * width + 2
    if n > 1 and n * len(values) * long > 4 * TABLE:
        for half in (rows[: n // 2], rows[n // 2 :]):
            _within_many(a, b, half, sizes, budget, found)
        return
    pattern, text = np.searchsorted(values, pattern), np.searchsorted(values, text)
    table = np.zeros(n * len(values) * long, np.uint64)
    owner = np.repeat(np.arange(n), m)
    place = np.arange(len(pattern)) - np.repeat(np.cumsum(m) - m, m) + 64 * width
    spot = (owner * len(values) + pattern) * long + (place >> 6)
    bit = place & 63
    by_bit = np.argsort(bit.astype(np.uint8), kind="stable")  # a number has each bit once
    ends = np.searchsorted(bit[by_bit], np.arange(65))
    for at in range(64):
        table[spot[by_bit[ends[at] : ends[at + 1]]]] |= np.uint64(1 << at)

    begins = np.cumsum(o) - o
    base = np.arange(n) * len(values)
    top, one = np.uint64(63), np.uint64(1)
    up = np.zeros((width, n), np.uint64)  # a row for each number of the band, the lowest first
    for word in range(width):
        low = min(max(64 * width - k - 1 - 64 * word, 0), 64)
        up[word] = np.uint64((1 << 64) - (1 << low))
    down = np.zeros((width, n), np.uint64)
    score = np.full(n, k, np.int64)
    turn = m - k  # from this step on the last row of the table is followed
    active, reach = n, np.arange(width + 1)[:, None]
    for step in range(int(o.max())):
        while o[active - 1] <= step:
            active -= 1
        live = slice(0, active)
        start = step + k + 1  # of the band, behind the empty numbers before the pattern
        word, shift = start >> 6, np.uint64(start & 63)
        spots = (base[live] + text.take(begins[live] + step)) * long + word
        same = table.take(spots + reach)
        if shift:
            same = (same[:-1] >> shift) | (same[1:] << (np.uint64(64) - shift))
        else:
            same = same[:-1]
        v, d = up[:, live], down[:, live]
        total = same & v
        total += v
        over = total < v
        carry = over[0]
        for w in range(1, width):  # what a number cannot hold goes to the next
            total[w] += carry
            carry = over[w] | (carry & (total[w] == 0))
        diagonal = (total ^ v) | same | d
        plus = d | ~(diagonal | v)
        minus = diagonal & v
        behind = step >= turn[live]
        change = one - (diagonal[-1] >> top)
        if behind.any():
            late = np.flatnonzero(behind)
            bits = 64 * width - 2 - (step - turn[late])
            words, off = bits >> 6, (bits & 63).astype(np.uint64)
            change = change.astype(np.int64)
            change[late] = 0
            for w in np.unique(words).tolist():
                here = words == w
                rises = (plus[w][late[here]] >> off[here]) & one
                falls = (minus[w][late[here]] >> off[here]) & one
                change[late[here]] = rises.astype(np.int64) - falls.astype(np.int64)
        score[live] += change.astype(np.int64)
        moved = diagonal >> one
        moved[:-1] |= diagonal[1:] << top
        up[:, live] = minus | ~(moved | plus)
        down[:, live] = moved & plus
    found[rows] = score <= budget[rows]
