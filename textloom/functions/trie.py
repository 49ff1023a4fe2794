"""All pairs of texts within an edit limit, by walking a trie with one band of the distance table per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Entries of a step of the walk (a query at a node): a bound on its memory.
STEP = 1 << 17


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Rows of code points, 0 beyond a text's end (and one more than the code point before it)."""
    out = np.zeros((len(texts), width), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat + 1
    return out


class Trie:
    """Different texts of one length. Level d holds their prefixes of d characters, in order."""

    def __init__(self, texts: list[str]):
        self.texts = sorted(texts)
        self.length = len(self.texts[0])
        codes = _codes(self.texts, self.length)
        differ = codes[1:] != codes[:-1]
        # Characters that a text has in common with the one before it.
        common = np.concatenate([[-1], differ.argmax(1) if len(differ) else []]).astype(np.int64)
        starts = [np.flatnonzero(common < d) for d in range(self.length + 1)]
        #: Per level: each node's first child and the one after its last; per level from 1: its character.
        self.first = [np.searchsorted(b, a) for a, b in zip(starts, starts[1:], strict=False)]
        self.end = [np.append(f[1:], len(b)) for f, b in zip(self.first, starts[1:], strict=True)]
        self.char = [codes[b, d] for d, b in enumerate(starts[1:])]

    def within(self, queries: list[str], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in ``queries``, places in ``texts``, distances) of all pairs within the limit, each once.

        A band holds, for i from d - limit to d + limit, the distance of the query's first i characters to a
        node's d, at most limit + 1. What is left of both has at least the difference of their lengths to come.
        """
        m, far = self.length, limit + 1
        lengths = np.array([len(q) for q in queries], np.int64)
        if not len(lengths):
            return
        pad = limit + 1
        # Character i - 1 of a query stands at i - 1 + pad.
        q = np.zeros((len(queries), int(max(lengths.max(), m)) + 2 * pad + limit), np.uint32)
        q[:, pad : pad + int(lengths.max())] = _codes(queries, int(lengths.max()))
        shifts = np.arange(-limit, limit + 1)
        rest = np.abs((lengths - m)[:, None] - shifts)  # at least so many edits after this shift
        rest = np.minimum(rest, far).astype(np.uint8)
        band = np.where(shifts >= 0, shifts, far).astype(np.uint8)
        rows = np.flatnonzero(np.abs(lengths - m) <= limit)
        todo = [(0, rows, np.zeros(len(rows), np.int64), np.tile(band, (len(rows), 1)))]
        while todo:
            d, at, node, band = todo.pop()
            if not len(at):
                continue
            if d == m:
                yield at, node, band[np.arange(len(at)), lengths[at] - m + limit].astype(np.int32)
                continue
            counts = self.end[d][node] - self.first[d][node]
            if len(at) > 1 and counts.sum() > STEP:
                half = len(at) // 2
                todo += [(d, at[half:], node[half:], band[half:]), (d, at[:half], node[:half], band[:half])]
                continue
            old = np.repeat(np.arange(len(at)), counts)
            child = self.first[d][node][old] + np.arange(len(old)) - np.repeat(np.cumsum(counts) - counts, counts)
            at, band, char = at[old], band[old], self.char[d][child]
            new = np.full((2 * limit + 1, len(at)), far, np.uint8)
            alive = np.zeros(len(at), bool)
            for b in range(2 * limit + 1):
                i = d + 1 + b - limit
                if i < 0:
                    continue
                best = band[:, b] + (q[at, i - 1 + pad] != char) if i else np.full(len(at), far, np.uint8)
                if b < 2 * limit:
                    best = np.minimum(best, band[:, b + 1] + np.uint8(1))
                if b:
                    best = np.minimum(best, new[b - 1] + np.uint8(1))
                new[b] = np.minimum(best, far)
                alive |= new[b] + rest[at, b] <= limit
            todo.append((d + 1, at[alive], child[alive], new[:, alive].T))
