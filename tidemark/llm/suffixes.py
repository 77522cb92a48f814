"""Suffix arrays of byte strings by induced sorting, as numpy steps over whole buckets and runs."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (a smaller sentinel follows the text, so the last isn't)."""
    n = len(t)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = -1
    # equal neighbours have the type of the next place where the text changes
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _leftmost(smaller: np.ndarray) -> np.ndarray:
    """Places of the leftmost-smaller suffixes: smaller ones that follow a larger one."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _stable(code: np.ndarray) -> np.ndarray:
    """A stable argsort of integers of 0 or more: places make them unique, and unique ones sort faster."""
    n = len(code)
    if not n or int(code.max()) >= (1 << 62) // n:
        return np.argsort(code, kind="stable")
    return np.argsort(code * n + np.arange(n))


def _stepped_back(j: np.ndarray, run_start: np.ndarray) -> np.ndarray:
    """What the members j of a bucket, each the last of a run of equal symbols, give to their own bucket.

    One step back gives all whose run has a symbol more, in the same order, two steps all that have two more, and so
    on; all steps are worked out at once, so a run costs its length and not a round for each symbol.
    """
    more = j - run_start[j]
    total = int(more.sum())
    if not total:
        return j[:0]
    who = np.repeat(np.arange(len(j)), more)
    steps = np.arange(total) - np.repeat(np.cumsum(more) - more, more) + 1
    order = np.argsort(steps, kind="stable")
    return j[who[order]] - steps[order]


def _induced(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order.

    First the larger-type suffixes by one pass over the buckets (first bytes) upwards, then the smaller-type ones by one
    pass downwards. Within a pass all suffixes of a bucket step back by one place together and are appended to their
    buckets in a stable way. Every suffix is placed once and looked at once.
    """
    n = len(t)
    sizes = np.bincount(t, minlength=256)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int64)
    by_bucket = np.bincount(t[lms], minlength=256)
    lms_from = np.cumsum(by_bucket) - by_bucket
    in_buckets = lms[np.argsort(t[lms], kind="stable")]
    run_start = np.maximum.accumulate(np.where(np.append(True, t[1:] != t[:-1]), np.arange(n), 0))
    head = starts.copy()

    def place(j: np.ndarray) -> None:
        """Appends suffixes to the fronts of their buckets."""
        c = t[j]
        order = np.argsort(c, kind="stable")
        c, j = c[order], j[order]
        k = np.bincount(c, minlength=256)
        sa[head[c] + np.arange(len(c)) - (np.cumsum(k) - k)[c]] = j
        head[:] += k

    place(np.array([n - 1]))  # the sentinel's predecessor
    for c in np.flatnonzero(sizes):
        own = sa[starts[c] : head[c]]
        place(_stepped_back(own, run_start))
        for j in (sa[starts[c] : head[c]], in_buckets[lms_from[c] : lms_from[c] + by_bucket[c]]):
            j = j[j > 0] - 1
            place(j[t[j] > c])
    tail = ends.copy()

    def place_back(j: np.ndarray) -> None:
        """Puts suffixes, largest first, at the ends of their buckets."""
        c = t[j]
        order = np.argsort(c, kind="stable")
        c, j = c[order], j[order]
        k = np.bincount(c, minlength=256)
        sa[tail[c] - 1 - (np.arange(len(c)) - (np.cumsum(k) - k)[c])] = j
        tail[:] -= k

    for c in np.flatnonzero(sizes)[::-1]:
        place_back(_stepped_back(sa[tail[c] : ends[c]][::-1], run_start))
        for j in (sa[tail[c] : ends[c]][::-1], sa[starts[c] : head[c]][::-1]):
            j = j[j > 0] - 1
            place_back(j[t[j] < c])
    return sa


def words_at(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as an integer; zeros follow the text."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    return np.ndarray(len(t), "<u8", padded.tobytes(), strides=(1,))


def _byte_names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For the leftmost-smaller places `order`, sorted by their substrings, whether each has the substring of the one before."""
    n = len(t)
    # a substring reaches to the next leftmost-smaller place, inclusive; the last one to the end of the text
    length = np.zeros(n, np.int64)
    length[lms] = np.append(lms[1:] + 1, n + 1) - lms
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    words = words_at(t)
    left, at = np.flatnonzero(same), 0
    while len(left):
        left = left[length[a[left]] > at]
        rest = length[a[left]] - at
        x, y = (words[np.minimum(p[left] + at, n - 1)] for p in (a, b))
        mask = np.where(rest >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * np.minimum(rest, 7).astype(np.uint64))) - np.uint64(1))
        differ = ((x ^ y) & mask) != 0
        same[left[differ]] = False
        left, at = left[~differ], at + 8
    return np.append(False, same)


def _by_chains(who: np.ndarray, code: np.ndarray, after: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """`who` in the order of their chains of codes: a place's own, then that of the place after it, up to the first that
    isn't inner, whose code decides. No chain is the beginning of another. Sorted from the chains' ends to their starts."""
    stages, at = [], who
    index = np.arange(len(who))
    while len(index):
        going = inner[at]
        stages.append((index, at, going))
        index, at = index[going], after[at[going]]
    order = np.zeros(0, np.int64)
    for index, at, going in reversed(stages):
        # those that end here join those that were sorted by what comes after
        place = np.empty(len(who), np.int64)
        place[index] = at
        own = np.concatenate([order, index[~going]])
        order = own[_stable(code[place[own]])]
    return who[order]


def _named_order(names: np.ndarray, depth: int | None) -> np.ndarray:
    """The suffixes of a string of names in order; with a depth, those that agree in so many names may be in any order.

    The induced sort again, over an alphabet of any size: every suffix is a chain down (larger type) or up (smaller
    type) to the suffix that induces it, runs of equal names being one link. Equal substrings get equal names again, and
    the string of those, at most half as long, is sorted by the same function.
    """
    n = len(names)
    if n < 2 or int(names.max()) + 1 == n or (depth is not None and depth <= 1):
        return _stable(names)
    smaller = _types(names)
    lms = _leftmost(smaller)
    ends_run = np.append(names[1:] != names[:-1], True)
    after = np.minimum.accumulate(np.where(ends_run, np.arange(n), n)[::-1])[::-1] + 1  # the place after the run of equal names
    run = after - np.arange(n)
    wide = 2 * n + 4
    larger_at, smaller_at = np.flatnonzero(~smaller), np.flatnonzero(smaller)

    def induced(lms: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Larger-type and smaller-type suffixes in order, from the ranks of the leftmost-smaller ones."""
        code = np.zeros(n + 1, np.int64)  # the sentinel's is the smallest
        code[larger_at] = names[larger_at] * wide + 1 + run[larger_at]
        code[lms] = names[lms] * wide + n + 3 + rank
        larger = _by_chains(larger_at, code, after, np.append(~smaller, False))
        code[larger] = names[larger] * wide + 1 + np.arange(len(larger))
        code[smaller_at] = names[smaller_at] * wide + 2 * n + 3 - run[smaller_at]
        return larger, _by_chains(smaller_at, code, after, np.append(smaller, False))

    if len(lms) > 1:
        _, up = induced(lms, np.zeros(len(lms), np.int64))
        is_lms = np.zeros(n + 1, bool)
        is_lms[lms] = True
        order = up[is_lms[up]]
        length = np.zeros(n, np.int64)
        length[lms] = np.append(lms[1:] + 1, n + 1) - lms
        a, b = order[:-1].copy(), order[1:].copy()
        same = length[a] == length[b]
        left, ended = np.flatnonzero(same), is_lms.copy()
        ended[n] = True
        x, y = a[left], b[left]
        first = True
        while len(left):
            stop = np.zeros(len(left), bool) if first else ended[x] | ended[y]
            own_run = np.where(stop, 0, run[np.minimum(x, n - 1)] - run[np.minimum(y, n - 1)])
            differ = (np.append(names, -1)[x] != np.append(names, -1)[y]) | (own_run != 0)
            same[left[differ]] = False
            go = ~differ & ~stop
            left, x, y, first = left[go], after[x[go]], after[y[go]], False
        name = np.zeros(n, np.int64)
        name[order] = np.append(0, np.cumsum(~same))
        lms = lms[_named_order(name[lms], None if depth is None else (depth + 1) // 2)]
    larger, up = induced(lms, np.arange(len(lms)))
    both = np.concatenate([larger, up])
    return both[_stable(names[both])]


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffixes of bytes t in order; with a depth, suffixes that agree in so many bytes may be in any order.

    Leftmost-smaller suffixes are put into buckets, and inducing once sorts the substrings between them. Equal ones get
    equal names; where names repeat, the suffixes of the string of names are sorted in turn, recursively, down to the
    depth. Inducing from that order gives the array.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    lms = _leftmost(_types(t))
    if len(lms) > 1:
        sa = _induced(t, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        name = np.zeros(n, np.int64)
        name[order] = np.cumsum(~_byte_names(t, lms, order)) - 1
        lms = lms[_named_order(name[lms], None if depth is None else (depth + 1) // 2)]
    return _induced(t, lms)


def permuted_matches(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each of the places `order`, sorted as suffixes, shares `length` bytes with the one before it in order.

    These are the permuted common prefixes cut at `length`: they are worked out in the order of the text, where
    neighbouring places read neighbouring bytes, and then put back.
    """
    out = np.zeros(len(order), bool)
    if len(order) < 2:
        return out
    words = words_at(t)
    by_place = np.argsort(order[1:])
    p, before = order[1:][by_place], order[:-1][by_place]
    same = np.ones(len(p), bool)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same &= words[p + at] == words[before + at]
    out[1:][by_place] = same
    return out
