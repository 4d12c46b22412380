"""Rank-ordered pair merging on length-bucketed padded matrices.

A row is one pre-token, a cell one symbol. In each round every unfinished row merges its
leftmost pair of least rank; ranks come from a hashed pair table, finished rows leave the
matrix and the rest close up by one column. Rows too long for a matrix go through a heap.
"""

from __future__ import annotations

import heapq

import numpy as np

NO_RANK = np.int32(2**31 - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)
#: Longest row that is merged in a matrix.
LONGEST_ROW = 256
_WIDTHS = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, LONGEST_ROW])
#: Cells of one matrix.
_CELLS = 1 << 20


class PairTable:
    """(left id, right id) -> merged id, for every way to cut a vocabulary string into two of its strings."""

    def __init__(self, vocabulary: dict, rank: np.ndarray):
        left, right, made = [], [], []
        for piece, number in vocabulary.items():
            for cut in range(1, len(piece)):
                a = vocabulary.get(piece[:cut])
                if a is not None and (b := vocabulary.get(piece[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(number)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(made, np.int32)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.made = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
        self.rank = np.append(rank.astype(np.int32), NO_RANK)  # index -1: no such pair
        slot, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == _EMPTY
            _, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.made[slot[put]] = keys[put], values[put]
            left_over = np.ones(len(keys), bool)
            left_over[put] = False
            todo = todo[left_over[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MUL) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, -1 where the pair doesn't merge. Negative ids never merge."""
        out = np.full(len(left), -1, np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[live].astype(np.uint64) << np.uint64(32)) | right[live].astype(np.uint64)
        slot = self._home(keys)
        while len(live):
            there = self.keys[slot]
            hit = there == keys
            out[live[hit]] = self.made[slot[hit]]
            go = ~hit & (there != _EMPTY)
            live, keys, slot = live[go], keys[go], (slot[go] + 1) & self.mask
        return out

    def merge(self, symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row symbols[offs[i]:offs[i+1]] to its end; returns flat symbols and offsets."""
        n = len(offs) - 1
        lens = np.diff(offs)
        short = np.flatnonzero(lens == 1)
        where, flat, sizes = [], [], []
        where.append(short), flat.append(symbols[offs[short]]), sizes.append(np.ones(len(short), np.int64))
        bucket = np.searchsorted(_WIDTHS, lens)
        for b in np.unique(bucket[lens > 1]):
            rows = np.flatnonzero((bucket == b) & (lens > 1))
            if b == len(_WIDTHS):
                for r in rows:
                    got = self._merge_long(symbols[offs[r] : offs[r + 1]])
                    where.append(np.array([r])), flat.append(got), sizes.append(np.array([len(got)]))
                continue
            step = max(1, _CELLS // int(_WIDTHS[b]))
            for at in range(0, len(rows), step):
                for ids, cells, length in self._merge_matrix(symbols, offs, rows[at : at + step], int(_WIDTHS[b])):
                    where.append(ids), flat.append(cells), sizes.append(length)
        order = np.concatenate(where)
        size = np.concatenate(sizes)
        values = np.concatenate(flat).astype(np.int32)
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        back = np.empty(n, np.int64)
        back[order] = np.arange(len(order))
        from tidemark.llm.runtime import ragged_take

        return ragged_take(values, at, back)

    def _merge_matrix(self, symbols, offs, rows, width):
        lens = offs[rows + 1] - offs[rows]
        col = np.arange(width)
        inside = col < lens[:, None]
        cells = np.full((len(rows), width), -1, np.int32)
        cells[inside] = symbols[(offs[rows][:, None] + col)[inside]]
        made = np.full((len(rows), width), -1, np.int32)
        made[:, :-1] = self.find(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(rows), width - 1)
        rank = self.rank[made]
        while len(rows):
            best = rank.argmin(1)
            line = np.arange(len(rows))
            go = rank[line, best] < NO_RANK
            if not go.all():
                end = ~go
                kept = cells[end]
                yield rows[end], kept[kept != -1], (kept != -1).sum(1)
                rows, cells, made, rank, best = rows[go], cells[go], made[go], rank[go], best[go]
                line = np.arange(len(rows))
                if not len(rows):
                    return
            cells[line, best] = made[line, best]
            w = cells.shape[1]
            pick = col[: w - 1] + (col[: w - 1] > best[:, None])
            cells = np.take_along_axis(cells, pick, 1)
            made = np.take_along_axis(made, pick, 1)
            rank = np.take_along_axis(rank, pick, 1)
            w -= 1
            here = cells[line, best]
            after = np.where(best + 1 < w, cells[line, np.minimum(best + 1, w - 1)], -1)
            made[line, best] = self.find(here, after)
            rank[line, best] = self.rank[made[line, best]]
            has = np.flatnonzero(best > 0)
            prev = best[has] - 1
            made[has, prev] = self.find(cells[has, prev], here[has])
            rank[has, prev] = self.rank[made[has, prev]]

    def _merge_long(self, row: np.ndarray) -> np.ndarray:
        """One long row, by a heap over its pairs: O(n log n)."""
        sym = row.tolist()
        n = len(sym)
        first = self.find(row[:-1].astype(np.int32), row[1:].astype(np.int32))
        rank = self.rank
        heap = [(int(rank[m]), i, sym[i], sym[i + 1], int(m)) for i, m in enumerate(first.tolist()) if m >= 0]
        heapq.heapify(heap)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        table: dict = {}

        def pair(i: int, j: int) -> None:
            key = (sym[i], sym[j])
            if key not in table:
                table[key] = int(self.find(np.array([key[0]], np.int32), np.array([key[1]], np.int32))[0])
            if (m := table[key]) >= 0:
                heapq.heappush(heap, (int(rank[m]), i, key[0], key[1], m))

        gone = -99  # no symbol, so that a stale heap entry never equals it
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = m, gone
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                pair(i, nxt[j])
            if prv[i] >= 0:
                pair(prv[i], i)
        return np.array([s for s in sym if s != gone], np.int32)
