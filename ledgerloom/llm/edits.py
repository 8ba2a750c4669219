"""Edit distances of many pairs of texts at once, for tasks that verify candidates.

Columns of the distance table are bits of 64-bit words (Myers, with carries between words as Hyyro has them). The words of
all pairs of a batch lie side by side in one array. A word takes a column one step after the word above it, so that the
carry is always at hand and every step is the same few array operations, whatever the lengths. A way of at most k edits keeps
to k + 1 diagonals, so only the words they cross take part at a time: one enters below with the largest values its neighbour
above allows, and where one has left above, the row over it is taken to grow with each column; neither lies on such a way.
"""

from __future__ import annotations

import numpy as np

WORDS = 4096  # of a batch, at most, unless one pair has more
TABLE = 1 << 20  # entries of a batch's table of letters
CUT = 64  # steps after which pairs that are too far apart leave the batch and words enter and leave; a word's letters at most
COMMON = 128  # letters of the texts' most frequent that a small table holds


class Letters:
    """Texts as numbers of their letters, the most frequent first."""

    def __init__(self, texts: list[str]):
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        often = np.bincount(flat, minlength=1)
        known = np.flatnonzero(often)
        rank = np.zeros(len(often), np.int32)
        rank[known[np.argsort(-often[known], kind="stable")]] = np.arange(len(known), dtype=np.int32)
        self.code, self.known = rank[flat], len(known)
        full = np.flatnonzero(self.size)
        self.rare = np.zeros(len(texts), bool)
        if len(full):
            self.rare[full] = np.maximum.reduceat(self.code, self.start[full]) >= COMMON

    def within(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether the edit distance of each pair (i, j) is at most ``most``, whole numbers."""
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        good = self.size[j] - self.size[i] <= most
        good &= (self.size[i] > 0) | (self.size[j] <= most)
        left = np.flatnonzero(good & (self.size[i] > 0))
        words = -(-self.size[i[left]] // 64)
        left = left[np.lexsort((-(self.size[j[left]] + words), self.rare[i[left]]))]
        words, rare = -(-self.size[i[left]] // 64), self.rare[i[left]]
        busy = np.minimum(words, most[left] // 64 + 3)
        at = 0
        while at < len(left):
            letters = self.known if rare[at] else min(self.known, COMMON)
            room = max(1, min(4 * WORDS, TABLE // (letters + 1)))
            to = at + max(1, min(int(np.searchsorted(np.cumsum(x[at : at + most_of]), most_of, side="right")) for x, most_of in ((words, room), (busy, WORDS))))
            if not rare[at]:
                to = min(to, int(np.searchsorted(rare, True)))
            some = left[at:to]
            good[some] = self._batch(i[some], j[some], most[some], letters)
            at = to
        return good

    def _batch(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, letters: int) -> np.ndarray:
        """The same for pairs of which i has letters below ``letters`` only; the longest come first."""
        m, n = self.size[i], self.size[j]
        words = -(-m // 64)
        first = np.cumsum(words) - words
        pair = np.repeat(np.arange(len(m)), words)
        row = np.arange(len(pair)) - first[pair]  # of words within their pair
        place, letter = ranges(self.start[i], m)
        owner = np.repeat(np.arange(len(m)), m)
        table = np.zeros((len(pair), letters + 1), np.uint64)  # the last column is a letter that nothing equals
        np.add.at(table.reshape(-1), (first[owner] + letter // 64) * (letters + 1) + self.code[place], np.uint64(1) << (letter % 64).astype(np.uint64))
        table = table.reshape(-1)
        width = n + 2 * (words - 1)
        begin = np.cumsum(width) - width
        padded = np.full(int(width.sum()), letters, np.int64)
        place, letter = ranges(self.start[j], n)
        padded[np.repeat(begin + words - 1, n) + letter] = np.minimum(self.code[place], letters)

        end = n + words - 1  # steps of each pair
        bottom, final = np.minimum(64 * (row + 1), m[pair]), first + words - 1
        over_by = (most - (n - m)) // 2  # letters that a way of so few edits can stray from the diagonals of start and end
        enter, leave = 65 * row - 64 - over_by[pair], bottom + row + (n - m + over_by)[pair]  # the steps between which a word takes part
        at_start, base, top = begin[pair] + words[pair] - 1 - row, np.arange(len(pair)) * (letters + 1), ((bottom - 1) % 64).astype(np.uint64)
        score_of, up_of, down_of = bottom.copy(), np.full(len(pair), ~np.uint64(0)), np.zeros(len(pair), np.uint64)
        plus_of, minus_of, was = (row == 0).astype(np.uint64), np.zeros(len(pair), np.uint64), enter <= 0
        good, alive, one, step = np.zeros(len(m), bool), np.ones(len(m), bool), np.uint64(1), 0
        while alive.any():
            active = np.flatnonzero(alive[pair] & (enter <= step) & (leave >= step))
            new = active[~was[active]]
            was[new] = True
            score_of[new] = score_of[new - 1] - plus_of[new].view(np.int64) + minus_of[new].view(np.int64) + bottom[new] - bottom[new - 1]
            score, up, down, plus, minus = (x[active] for x in (score_of, up_of, down_of, plus_of, minus_of))
            at, mine, tops, size = at_start[active] + step, base[active], top[active], len(active)
            own = pair[active]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            head = np.zeros(size, np.uint64)
            head[heads] = 1
            body = 1 - head
            cell, (over, under, zero, same, across, p, q) = np.empty(size, np.int64), np.empty((7, size), np.uint64)
            until = min(int(end[own[-1]]), step + CUT)  # the last pair is the first to end
            for _ in range(until - step):
                padded.take(at, out=cell, mode="clip")
                cell += mine
                table.take(cell, out=same, mode="clip")
                at += 1
                np.bitwise_or(same, down, out=across)
                same |= minus
                np.bitwise_and(same, up, out=zero)
                zero += up
                zero ^= up
                zero |= same
                np.bitwise_or(zero, up, out=p)
                np.invert(p, out=p)
                p |= down
                np.bitwise_and(up, zero, out=q)
                np.right_shift(p, tops, out=over)
                over &= one
                np.right_shift(q, tops, out=under)
                under &= one
                score += over.view(np.int64)
                score -= under.view(np.int64)
                p <<= one
                p |= plus
                q <<= one
                q |= minus
                np.bitwise_or(across, p, out=up)
                np.invert(up, out=up)
                up |= q
                np.bitwise_and(p, across, out=down)
                np.bitwise_and(over[:-1], body[1:], out=plus[1:])
                np.bitwise_and(under[:-1], body[1:], out=minus[1:])
                plus |= head
                minus[0] = 0
            step = until
            score_of[active], up_of[active], down_of[active], plus_of[active], minus_of[active] = score, up, down, plus, minus
            lowest = np.flatnonzero(np.append(own[1:] != own[:-1], True))
            below = active[lowest] + 1
            within = active[lowest] != final[own[lowest]]
            plus_of[below[within]], minus_of[below[within]] = over[lowest[within]], under[lowest[within]]
            now = own[heads]
            done = end[now] <= step
            good[now[done]] = score_of[final[now[done]]] <= most[now[done]]
            # a way to the end passes the letters done so far within a word of some bottom row
            ahead = np.abs((m[own] - bottom[active]) - (n[own] - np.clip(step - row[active], 0, n[own])))
            least = np.minimum.reduceat(score - 65 + np.maximum(ahead - 65, 0), heads)
            alive[now[done | (least > most[now])]] = False
        return good


def ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and each one's number within its range."""
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(start, size) + inner, inner
