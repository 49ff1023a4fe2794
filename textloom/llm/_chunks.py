"""Cutting texts where every pre-token ends, and a bounded memo of what becomes of each cut.

The public byte-level patterns never let a pre-token run across the start of `` word`` (one optional
space, then no white space), and they match runs of white space alone. So a text may be cut there,
each cut encoded by itself, and the results joined: the ids are those of the whole text. Cuts repeat
a lot, so each distinct one is encoded once per worker.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: The code points with the White_Space property, as a character class's content.
WHITE = r"\t-\r \x85\xa0  -     　"
_CUTS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Entries of a generation of a worker's memo. It keeps two: when the newer is full, the older goes, and
#: what is used again moves to the newer.
MEMO_ENTRIES = 400_000
#: The same for memos of packed ids, which are smaller.
LOOKUP_ENTRIES = 500_000
#: Longer cuts are encoded each time they occur.
MEMO_CHARS = 64
#: Characters of text whose new cuts are encoded in one call.
GROUP_CHARS = 1 << 17

cuts = _CUTS.findall


def collector_off(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For batch functions with a large memo free of cycles: the collector would walk it over and over. It
    is on again afterwards, as workers serve other functions too, and what the task no longer needs goes back
    to the system: idle workers stand beside those of the next stage."""

    def off(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            handed_back()

    return off


def handed_back() -> None:
    """Free memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


class Memo:
    """cut -> value; ``encode`` gets a list of new cuts and returns their values."""

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode = encode
        self.newer: dict = {}
        self.older: dict = {}

    def values(self, texts: Iterable[str]) -> Iterator[list]:
        """The values of each text's cuts, text by text."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(cuts(text))
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, held: list[list[str]]) -> Iterator[list]:
        known = [list(map(self.newer.get, found)) for found in held]
        lost = {c for found, out in zip(held, known, strict=True) if None in out for c, v in zip(found, out, strict=True) if v is None}
        again = {c: self.older[c] for c in lost if c in self.older}
        new = [c for c in lost if c not in again]
        again.update(zip(new, self.encode(new), strict=True))
        for found, out in zip(held, known, strict=True):
            yield [again[c] if v is None else v for c, v in zip(found, out, strict=True)] if None in out else out
        if len(self.newer) + len(again) > MEMO_ENTRIES:
            self.older, self.newer = self.newer, {}
        self.newer.update((c, v) for c, v in again.items() if len(c) <= MEMO_CHARS)


class Lookup(dict):
    """cut -> value, one new cut at a time; starts anew, keeping the old generation, when ``full``."""

    def __init__(self, encode: Callable[[str], bytes], older: dict | None = None):
        super().__init__()
        self.encode, self.older = encode, older or {}

    def __missing__(self, cut: str) -> bytes:
        value = self.older.get(cut)
        if value is None:
            value = self.encode(cut)
        if len(cut) <= MEMO_CHARS:
            self[cut] = value
        return value

    def full(self) -> bool:
        return len(self) > LOOKUP_ENTRIES

    def successor(self) -> Lookup:
        self.older = {}
        return Lookup(self.encode, self)
