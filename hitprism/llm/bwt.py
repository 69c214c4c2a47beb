"""Burrows-Wheeler transform and common prefixes of a collection of byte strings.

The collection grows by columns, from the last one: each round puts one symbol of
every string in front of its suffix. A string's new suffix ``cS`` follows all
suffixes with a smaller first symbol and those ``cS'`` with ``S'`` before ``S``, so
its place is a count of ``c`` in the transform up to the place of ``S``. Its common
prefix with the suffix before it is one more than the least common prefix between
the places of ``S'`` and ``S``; the same holds for the suffix after it.

Transform and common prefixes are one sequence, read and written front to back in
each round. Counts are kept for blocks of it, which grow as symbols are put in.
"""

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

_BLOCK = 192
_NEAR = (24, 160)


class _Counts:
    """How often each symbol occurs before a place: counts per block, and a look
    at the places between the block's start and the place."""

    def __init__(self, kinds):
        self.kinds = kinds

    def rebuild(self, symbols):
        n = len(symbols)
        self.starts = np.arange(0, n, _BLOCK)
        block = np.repeat(np.arange(len(self.starts)) * self.kinds, _BLOCK)[:n]
        self.counts = np.bincount(block + symbols, minlength=len(self.starts) * self.kinds).reshape(-1, self.kinds).astype(np.int32)
        self.longest = _BLOCK

    def insert(self, places, symbols):
        """Symbols were put in before the old places given, in order."""
        block = np.searchsorted(self.starts, places, side="right") - 1
        np.add.at(self.counts.reshape(-1), block * self.kinds + symbols, 1)
        new = np.bincount(block, minlength=len(self.starts))
        self.starts = self.starts + np.cumsum(new) - new

    def before(self, seq, places, symbols):
        """Occurrences of each symbol before its place, and of all symbols."""
        sizes = np.diff(self.starts, append=len(seq.symbols))
        if sizes.max(initial=0) > 3 * _BLOCK:
            self.rebuild(seq.symbols)
            sizes = np.diff(self.starts, append=len(seq.symbols))
        upto = np.cumsum(self.counts, axis=0)
        block = np.searchsorted(self.starts, places, side="right") - 1
        out = np.where(block > 0, upto[np.maximum(block - 1, 0), symbols], 0)
        inside = places - self.starts[block]
        for low, high in ((0, 48), (48, 96), (96, _BLOCK), (_BLOCK, 3 * _BLOCK)):
            at = np.flatnonzero((inside > low) & (inside <= high))
            if len(at):
                near = seq.back(seq.symbols_padded, places[at], high) == symbols[at, None]
                near &= np.arange(high, 0, -1) <= inside[at, None]
                out[at] += near.sum(axis=1)
        return out, upto[-1]


class _Sequence:
    """The transform and the common prefix of each suffix with the one before it,
    padded at both ends so that a look around a place never leaves them."""

    PAD = 3 * _BLOCK

    def __init__(self, symbols, common):
        pad = np.zeros(self.PAD, np.uint8)
        self.symbols_padded = np.concatenate([pad, symbols, pad])
        self.common_padded = np.concatenate([pad, common, pad])
        self._view()

    def _view(self):
        self.symbols = self.symbols_padded[self.PAD:-self.PAD]
        self.common = self.common_padded[self.PAD:-self.PAD]

    def back(self, padded, places, width):
        """The ``width`` values before each place."""
        return sliding_window_view(padded, width)[places + (self.PAD - width)]

    def ahead(self, padded, places, width):
        """The ``width`` values from each place on."""
        return sliding_window_view(padded, width)[places + self.PAD]

    def insert(self, places, symbols, common):
        """New values; ``places`` are where they stand afterwards, in order."""
        n = len(self.symbols_padded) + len(places)
        old = np.ones(n, bool)
        old[places + self.PAD] = False
        for name, new in (("symbols_padded", symbols), ("common_padded", common)):
            out = np.empty(n, np.uint8)
            out[old] = getattr(self, name)
            out[places + self.PAD] = new
            setattr(self, name, out)
        self._view()

    def least_back(self, places, symbols):
        """Least common prefix from after the last occurrence of the symbol before
        each place up to the place itself. There must be one."""
        out = self.common[places].astype(np.int64)
        left, upto = np.flatnonzero(out > 0), places.copy()
        for width in _NEAR:
            found = self.back(self.symbols_padded, upto[left], width) == symbols[left, None]
            last = width - 1 - np.argmax(found[:, ::-1], axis=1)
            last[~found.any(axis=1)] = -1
            values = self.back(self.common_padded, upto[left], width)
            values[np.arange(width) <= last[:, None]] = 255
            out[left] = np.minimum(out[left], values.min(axis=1))
            upto[left] -= width
            left = left[(last < 0) & (out[left] > 0)]
        if len(left):
            whole = self.symbols.tobytes()
            for i in left.tolist():
                there = whole.rfind(symbols[i], 0, upto[i])
                out[i] = min(out[i], self.common[there + 1:upto[i]].min(initial=255))
        return out

    def least_ahead(self, places, symbols):
        """The same from after each place up to the next occurrence of the symbol."""
        out = np.full(len(places), 255, np.int64)
        left, since = np.arange(len(places)), places + 1
        for width in _NEAR:
            found = self.ahead(self.symbols_padded, since[left], width) == symbols[left, None]
            first = np.argmax(found, axis=1)
            first[~found.any(axis=1)] = width
            values = self.ahead(self.common_padded, since[left], width)
            values[np.arange(width) > first[:, None]] = 255
            out[left] = np.minimum(out[left], values.min(axis=1))
            since[left] += width
            left = left[(first == width) & (out[left] > 0)]
        if len(left):
            whole = self.symbols.tobytes()
            for i in left.tolist():
                there = whole.find(symbols[i], since[i])
                out[i] = min(out[i], self.common[since[i]:there + 1].min(initial=255))
        return out


def column_wise(data, starts, sizes, common, depth):
    """Transform (0 where a string starts) and common prefixes, cut at ``depth``
    (at most 254), of the suffixes of the strings ``data[start:start + size]``.

    Each string ends with a marker of its own; the markers come first, in the order
    of the strings. ``common``: what each marker shares with the one before, as they
    may stand for what follows the strings. There may be 255 different bytes in all.
    """
    used = np.zeros(256, bool)
    used[data] = True
    kinds = int(used.sum()) + 1
    if kinds > 256:
        raise ValueError("at most 255 different bytes can be told apart")
    # one more value, for strings that are empty
    code = np.append(np.cumsum(used).astype(np.uint8)[data], np.uint8(0))

    n = len(starts)
    last = starts + sizes - 1
    seq, counts = _Sequence(np.where(sizes > 0, code[last], 0).astype(np.uint8), np.minimum(common, depth).astype(np.uint8)), _Counts(kinds)
    counts.rebuild(seq.symbols)
    who = np.flatnonzero(sizes > 0)
    places, length = who.copy(), 0
    while len(who):
        length += 1
        symbols = seq.symbols[places]
        # by first symbol, then in the order that the rest had
        order = np.argsort(symbols, kind="stable")
        who, places, symbols = who[order], places[order], symbols[order]
        rank, totals = counts.before(seq, places, symbols)
        base = np.full(kinds, n, np.int64)  # where suffixes with each first symbol begin
        base[2:] += np.cumsum(totals[1:-1])
        new = base[symbols] + rank
        earlier, later = rank > 0, rank + 1 < totals[symbols]
        common, after = np.zeros((2, len(who)), np.uint8)
        common[earlier] = np.minimum(seq.least_back(places[earlier], symbols[earlier]) + 1, depth)
        after[later] = np.minimum(seq.least_ahead(places[later], symbols[later]) + 1, depth)
        ended = sizes[who] == length
        put = np.where(ended, 0, code[last[who] - length])
        # ``new`` counts the new suffixes, too; before them, they stood this many earlier
        counts.insert(new - np.arange(len(new)), put)
        seq.insert(new, put, common)
        inner = new + 1 < len(seq.common)
        seq.common[new[inner] + 1] = after[inner]
        who, places = who[~ended], new[~ended]
    return seq.symbols, seq.common


def walk(transform, n):
    """For each length from 0 on: the strings that have a suffix of it, and its
    place among all suffixes."""
    kinds = int(transform.max(initial=0)) + 1
    totals = np.bincount(transform, minlength=kinds)
    order = np.argsort(transform, kind="stable")[totals[0]:]
    following = np.zeros(len(transform), np.int64)
    following[order] = n + np.arange(len(order))
    who, places = np.arange(n), np.arange(n)
    while len(who):
        yield who, places
        more = transform[places] > 0
        who, places = who[more], following[places[more]]
