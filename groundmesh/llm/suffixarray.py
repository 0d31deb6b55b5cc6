"""Suffix arrays by two-stage sorting, and adjacent common prefixes, over the strings that one task holds.

Only suffixes smaller than their successors are sorted directly: each is cut into blocks from one such suffix to the next, blocks are
named by their symbols, and names are doubled along the chain of blocks. All other suffixes are induced by one scan of the buckets,
from the smallest symbol up: the suffix before a sorted one follows in the bucket of its own first symbol. Orders are right for
the first ``depth`` symbols of a suffix, or up to its string's end; suffixes that agree so far stay in text order. At most 2**31
symbols are sorted together.
"""

from __future__ import annotations

import numpy as np

#: Symbols with their type that one word of a block's name holds: ten bits each.
NAMED = 6


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All strings in one array, bytes as 1 to 256 and a 0 after each; and the place where each begins."""
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) + 1
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join([*strings, b""]), dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    text[begin + sizes - 1] = 0
    return text, begin


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that begins a symbol later; the last counts as one."""
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    rising = np.append(text[change[:-1]] < text[change[:-1] + 1], True)
    return np.repeat(rising, np.diff(change, prepend=-1))


def group_starts(keys: np.ndarray) -> np.ndarray:
    """For each entry of sorted keys the index of the first equal one."""
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.flatnonzero(first)
    return np.repeat(at, np.diff(at, append=len(keys)))


def refine(rank: np.ndarray, some: np.ndarray, key: np.ndarray) -> None:
    """Split groups of equal rank by key; ``some`` holds whole groups. A rank is the number of suffixes in earlier groups."""
    old = rank[some]
    if not old.any():
        order = np.argsort(key)
    elif 3 * (bits := len(rank).bit_length()) < 64 and key.dtype == np.int64:  # rank, key and place fit one word
        order = np.sort((((old << bits) | key) << bits) | np.arange(len(some))) & ((1 << bits) - 1)
    else:
        order = np.lexsort((key, old))
    old, key, at = old[order], key[order], some[order]
    group = group_starts(old)
    changed = np.concatenate([[True], (old[1:] != old[:-1]) | (key[1:] != key[:-1])])
    first = np.flatnonzero(changed)
    rank[at] = old + np.repeat(first, np.diff(first, append=len(at))) - group


def shared(rank: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Those of ``some`` whose rank is not theirs alone."""
    return some[np.bincount(rank, minlength=len(rank))[rank[some]] > 1]


def sorted_directly(text: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes marked ``small`` in order."""
    at = np.flatnonzero(small)
    number = np.arange(len(at))
    ends = text[at] == 0
    following = np.where(ends, number, np.minimum(number + 1, len(at) - 1))
    length = at[following] - at
    code = np.concatenate([(text.astype(np.uint64) << np.uint64(1)) | small, np.zeros(NAMED, dtype=np.uint64)])
    covered = np.where(ends, np.int64(1) << 40, length)

    def word(some: np.ndarray, skip: int) -> np.ndarray:
        out = np.zeros(len(some), dtype=np.uint64)
        for j in range(skip, skip + NAMED):
            inside = j <= length[some]
            out = (out << np.uint64(10)) | np.where(inside, code[at[some] + np.where(inside, j, 0)], np.uint64(0))
        return out

    rank = np.zeros(len(at), dtype=np.int64)
    some, skip = number, 0
    while len(some):
        refine(rank, some, word(some, skip))
        skip += NAMED
        some = shared(rank, some)
        some = some[length[some] >= skip]
    jump = following
    some = shared(rank, number)
    while len(some := some[covered[some] < depth]):
        refine(rank, some, rank[jump[some]])
        covered = np.minimum(covered + covered[jump], np.int64(1) << 40)
        jump = jump[jump]
        some = shared(rank, some)
    return at[np.sort((rank << 32) | number) & ((1 << 32) - 1)]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in order, from ``joined`` strings."""
    direct = sorted_directly(text, smaller_than_successor(text), depth)
    symbols = np.unique(text).tolist()
    bounds = np.searchsorted(text[direct], np.append(symbols, 1 << 15))
    induced: dict[int, list[np.ndarray]] = {c: [] for c in symbols}
    out = []
    for n, c in enumerate(symbols):
        waves = []
        wave = np.concatenate(induced.pop(c) or [direct[:0]])
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        bucket = np.concatenate([*waves, direct[bounds[n] : bounds[n + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        starts = np.flatnonzero(np.diff(first, prepend=0))
        for part, d in zip(np.split(before, starts[1:]), first[starts].tolist(), strict=True) if len(before) else ():
            induced[d].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the suffix before its own in order (-1: none), and the length of the prefix that both share, within their strings.

    Along places whose neighbours move on with them a prefix shrinks by one; only where that breaks are symbols compared.
    """
    n = len(text)
    neighbour = np.full(n, -1)
    neighbour[order[1:]] = order[:-1]
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    q, p = neighbour[:-1], neighbour[1:]
    moves_on = (p == q + 1) & (q >= 0) & (text[:-1] > 0) & (text[:-1] == text[q])
    starts = np.flatnonzero(np.concatenate([[True], ~moves_on]))
    a, b = starts, neighbour[starts]
    most = np.where(b >= 0, np.minimum(left[a], left[np.maximum(b, 0)]), 0)
    raw = np.concatenate([(text - np.uint16(1)).astype(np.uint8), np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    length = np.zeros(len(starts), dtype=np.int64)
    some, done = np.flatnonzero(most > 0), 0
    while len(some):
        x = (np.ascontiguousarray(words[a[some] + done]).view("<u8") ^ np.ascontiguousarray(words[b[some] + done]).view("<u8")).ravel()
        differs = x != 0
        lowest = x[differs] & (~x[differs] + np.uint64(1))
        length[some[differs]] = done + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
        some, done = some[~differs], done + 8
        length[some] = done
        some = some[most[some] > done]
    length = np.minimum(length, most)
    size = np.diff(starts, append=n)
    return neighbour, np.repeat(length, size) - (np.arange(n) - np.repeat(starts, size))


def repeated_places(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``width`` symbols also begin elsewhere in the strings, and where each string begins in the array of all."""
    text, begin = joined(strings)
    neighbour, length = common_prefixes(text, suffix_array(text, width))
    found = np.flatnonzero(length >= width)
    return np.unique(np.concatenate([found, neighbour[found]])), begin
