"""Byte-pair merges of many symbol sequences at once, in vectorised rounds.

Sequences are cut into chunks of CHUNK symbols. In each round every chunk merges the pair of its least rank wherever it occurs, from the
left and without overlap, all chunks at once, and the arrays are compacted. Where a new pair would come before the one that made it, the
chunk's round ends with that merge, so that the order is the same as with one merge at a time. There are fewer than CHUNK rounds. Then the cuts are mended: neighbours at a cut are right if merging
their two texts alone gives them again, since no merge of the whole sequence can cross between them otherwise. Stretches about cuts where
it doesn't are merged anew, ever longer ones, until all are right. The result is that of one merge at a time for a sequence of any length,
also where a longer piece outranks its parts.
"""

from __future__ import annotations

import numpy as np

CHUNK = 64
_NONE = np.iinfo(np.int64).max
_ABSENT = -2


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all spans, one after the other, and the number of each place's span."""
    length = ends - starts
    own = np.repeat(np.arange(len(starts)), length)
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + starts[own], own


class Merger:
    """Merge rules as arrays: the key left * width + right of each pair, found by its hash, with its rank and the symbol that it becomes."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], width: int) -> None:
        keys = np.array([a * width + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        # a last entry that no key equals
        self.width, self.keys = width, np.append(keys[order], _ABSENT)
        rank, merged = np.array(list(pairs.values()), np.int64).reshape(-1, 2)[order].T
        self.rank, self.merged = np.append(rank, _NONE), np.append(merged, -1)
        # places of the keys by their hash, the next free one if it is taken
        bits = max(len(keys), 1).bit_length() + 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, len(keys))
        left, slot = np.arange(len(keys)), self._slot(self.keys[:-1])
        while len(left):
            free = self.place[slot] == len(keys)
            self.place[slot[free]] = left[free]
            left, slot = (x[self.place[slot] != left] for x in (left, slot))
            slot = (slot + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; _NONE for pairs that don't merge."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        slot = self._slot(key)
        at, none = self.place[slot], len(self.keys) - 1
        other = np.flatnonzero((self.keys[at] != key) & (at != none))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            at[other] = self.place[slot[other]]
            other = other[(self.keys[at[other]] != key[other]) & (at[other] != none)]
        return self.rank[at], self.merged[at]

    def merge(self, symbol: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, with the place of their first character."""
        at = np.arange(len(symbol))
        first = np.maximum.accumulate(np.where(np.append(True, segment[1:] != segment[:-1]), at, 0))
        cut = (at - first) % CHUNK == 0
        merged, places = self._rounds(symbol, np.cumsum(cut))
        cuts, reach = np.flatnonzero(cut & (at != first)), 1
        while len(cuts):
            own = segment[places]
            k = np.searchsorted(places, cuts)
            low = np.maximum(k - reach, np.searchsorted(own, own[k]))
            high = np.minimum(k + reach, np.searchsorted(own, own[k], "right"))
            ends = np.append(places, len(symbol))
            # stretches that overlap are one
            apart = np.append(True, low[1:] >= np.maximum.accumulate(high)[:-1])
            low, high = low[apart], np.maximum.reduceat(high, np.flatnonzero(apart))
            old, number = _spans(low, high)
            where, stretch = _spans(ends[low], ends[high])
            new, starts = self._rounds(symbol[where], stretch)
            number_new, starts = stretch[starts], where[starts]
            same = np.bincount(number, minlength=len(low)) == np.bincount(number_new, minlength=len(low))
            kept, again = same[number], same[number_new]
            same[number[kept][places[old[kept]] != starts[again]]] = False
            gone = old[~same[number]]
            put = ~same[number_new]
            edges = np.unique(np.concatenate((ends[low[~same]], ends[high[~same]])))
            cuts = edges[(edges < len(symbol)) & (first[np.minimum(edges, len(symbol) - 1)] != edges)]
            merged, places = np.append(np.delete(merged, gone), new[put]), np.append(np.delete(places, gone), starts[put])
            order = np.argsort(places, kind="stable")
            merged, places, reach = merged[order], places[order], reach * 2
        return merged, places

    def _rounds(self, symbol: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `merge` gives, in as many rounds as the longest segment has merges."""
        symbol, place, done = symbol.copy(), np.arange(len(symbol)), []
        # the pair of a symbol is it and its follower within the segment
        rank, result = np.full(len(symbol), _NONE), np.full(len(symbol), -1)
        inside = np.flatnonzero(segment[:-1] == segment[1:])
        rank[inside], result[inside] = self._look_up(symbol[inside], symbol[inside + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            length = np.diff(np.append(starts, len(symbol)))
            least = np.repeat(np.minimum.reduceat(rank, starts), length)
            ended = least == _NONE
            if ended.any():
                done.append((symbol[ended], place[ended]))
                live = ~ended
                symbol, segment, place, rank, result, least = (x[live] for x in (symbol, segment, place, rank, result, least))
                continue
            best = self._together(np.flatnonzero(rank == least), symbol, segment, rank, result)
            symbol[best] = result[best]
            stays = np.ones(len(symbol), bool)
            stays[best + 1] = False
            new = np.cumsum(stays) - 1
            symbol, segment, place, rank, result = (x[stays] for x in (symbol, segment, place, rank, result))
            at = new[best]
            touched = np.zeros(len(symbol), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            changed = np.flatnonzero(touched)
            follows = np.append(segment[1:] == segment[:-1], False)[changed] if len(segment) > 1 else np.zeros(len(changed), bool)
            rank[changed], result[changed] = _NONE, -1
            inside = changed[follows]
            rank[inside], result[inside] = self._look_up(symbol[inside], symbol[inside + 1])
        symbols, places = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(places, kind="stable")
        return symbols[order], places[order]

    def _together(self, best: np.ndarray, symbol: np.ndarray, segment: np.ndarray, rank: np.ndarray, result: np.ndarray) -> np.ndarray:
        """Of the places of each segment's least rank, those that merge in this round."""
        at = np.arange(len(best))
        joins = np.append(False, best[1:] == best[:-1] + 1)
        best = best[(at - np.maximum.accumulate(np.where(joins, 0, at))) % 2 == 0]
        own = segment[best]
        first = np.append(True, own[1:] != own[:-1])
        if first.all():
            return best
        some = np.flatnonzero(~first | np.append(~first[1:], False))  # a segment with one merge has nothing to check
        place, size = best[some], len(symbol)
        made = result[place]
        before = np.where(place > 0, symbol[place - 1], -1)
        follows = np.append(False, (place[1:] == place[:-1] + 2) & (own[some][1:] == own[some][:-1]))
        before[follows] = made[np.flatnonzero(follows) - 1]
        before[(place == 0) | (segment[place - 1] != segment[place])] = -1
        end = np.minimum(place + 2, size - 1)
        after = np.where((place + 2 < size) & (segment[end] == segment[place]), symbol[end], -1)
        early = np.minimum(self._look_up(before, made)[0], self._look_up(made, after)[0]) <= rank[place]
        if not early.any():
            return best
        stop = np.zeros(len(best), int)
        stop[some] = early
        seen = np.cumsum(stop) - stop
        return best[seen == np.maximum.accumulate(np.where(first, seen, 0))]
