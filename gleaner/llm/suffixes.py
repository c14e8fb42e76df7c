"""Suffix order, longest common prefixes and longest previous factors of a set of texts (numpy).

A position is earlier than another if its text belongs to a smaller document.  The longest
previous factor of a position is the longest prefix of its suffix that also starts at an
earlier one.  In suffix order it is found at the nearest position before or behind that is
earlier: all between belong to no earlier document, and any further one shares no more.
Values are cut at a depth, which is all that a minimal length needs.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


class SuffixOrder:
    """Ranks of all positions by their first ``depth`` symbols, by prefix doubling.

    ``packed``: symbols are bytes, eight of which are one number to begin with; for depths of eight or more.
    """

    def __init__(self, symbols: np.ndarray, depth: int, packed: bool) -> None:
        self.depth, self.key = depth, None
        if packed:
            key, have = np.zeros(len(symbols), _U), 8
            padded = np.r_[symbols.astype(_U), np.zeros(8, _U)]
            for i in range(8):
                key = (key << _U(8)) | padded[i : i + len(symbols)]
            self.key = key
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        else:
            rank, have = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
        self.levels = [(have, rank)]
        while have < depth:
            step = min(have, depth - have)
            behind = np.r_[rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)]
            rank = np.unique(rank << 32 | behind, return_inverse=True)[1].astype(np.int64)
            have += step
            self.levels.append((have, rank))

    @property
    def rank(self) -> np.ndarray:
        return self.levels[-1][1]

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols, up to ``depth``, that the suffixes at ``a`` and at ``b`` begin with alike."""
        n = len(self.rank)
        found = np.zeros(len(a), np.int64)
        whole = self.rank[a] == self.rank[b]
        for have, rank in reversed([x for x in self.levels if x[0] < self.depth]):
            x, y = a + found, b + found
            inside = (x < n) & (y < n)
            found[inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])] += have
        if self.key is not None:  # less than eight bytes more
            x, y = a + found, b + found
            inside = (x < n) & (y < n)
            differ = self.key[np.minimum(x, n - 1)] ^ self.key[np.minimum(y, n - 1)]
            for bits in range(56, 0, -8):
                found += inside & (differ >> _U(bits) == 0)
        return np.where(whole, self.depth, np.minimum(found, self.depth - 1))


def previous_smaller(values: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place the nearest one before with a smaller value (or -1), and the least of ``common`` on the way.

    ``common[i]`` belongs to the step from i - 1 to i.  Minima over stretches of 1, 2, 4, ...
    places tell how far back all values are no smaller.
    """
    n = len(values)
    least, shared = [values], [common]
    width = 1
    while 2 * width < n:
        a, b = least[-1].copy(), shared[-1].copy()
        np.minimum(a[width:], least[-1][:-width], out=a[width:])
        np.minimum(b[width:], shared[-1][:-width], out=b[width:])
        least.append(a)
        shared.append(b)
        width *= 2
    at = np.arange(n)
    on_the_way = np.full(n, np.iinfo(common.dtype).max, common.dtype)
    for k in range(len(least) - 1, -1, -1):
        step = 1 << k
        back = np.flatnonzero(at >= step)
        back = back[least[k][at[back] - 1] >= values[back]]
        on_the_way[back] = np.minimum(on_the_way[back], shared[k][at[back]])
        at[back] -= step
    found = at > 0
    on_the_way = np.where(found, np.minimum(on_the_way, common[at]), 0)
    return at - 1, on_the_way


def longest_previous_factors(docs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of every place in suffix order.

    ``docs``: the document at each place; ``common[i]``: the common prefix of places i - 1 and i.
    """
    before = previous_smaller(docs, common)[1]
    turned = np.r_[common[:1], common[1:][::-1]]
    behind = previous_smaller(docs[::-1], turned)[1][::-1]
    return np.maximum(before, behind)


def repeated_windows(texts: list[bytes], docs: np.ndarray, kind: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of the windows of ``length`` symbols that also start in the text of a smaller document."""
    if kind == "bytes":
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = np.frombuffer(b"".join(texts), np.uint8)
    else:
        names: dict[bytes, int] = {}
        split = [c.split(b" ") for c in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        symbols = np.fromiter((names.setdefault(w, len(names)) for words in split for w in words), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(offset + length <= sizes[owner])
    if not len(at):
        return at, at
    suffixes = SuffixOrder(symbols, length, kind == "bytes")
    at = at[np.argsort(suffixes.rank[at], kind="stable")]
    common = np.zeros(len(at), np.int16)
    common[1:] = suffixes.common_prefix(at[:-1], at[1:])
    again = at[longest_previous_factors(docs[owner[at]], common) >= length]
    return owner[again], offset[again]
