"""Edit distances of many pairs at once (bit-parallel, in numpy).

The dynamic programme of one pair is a matrix; its columns are kept as bit
vectors of their vertical differences (64 rows of the shorter string a word)
and advanced by a few word operations. A word needs the word above it in the
same column only, so the words of a pair work in a wavefront, each one column
behind the one above, and the words of many pairs are the lanes of one array: a
step advances all of them by 64 cells each. Distances are in code points, like
Spark's ``levenshtein``.

Many texts that meet the same few originals are ``Patterns``: all lanes of a
step read the same letter, so a step needs no gathers, and the letter masks of
the texts serve every original.
"""

from __future__ import annotations

import numpy as np

#: Words advanced together: at most, and as many at least (if there are) before a group of pairs ends.
WORDS, FEW = 16384, 1024
#: Characters of the longer strings of a group, padded, at most.
STATE = 1 << 23
_ONE = np.uint64(1)
_ALL = np.uint64(2**64 - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Unit-cost edit distance of each pair (a[i], b[i]) of code point arrays."""
    n = len(a)
    la = np.fromiter(map(len, a), np.int64, n)
    lb = np.fromiter(map(len, b), np.int64, n)
    m, width = np.minimum(la, lb), np.maximum(la, lb)
    out = width.copy()  # right where one side is empty
    order = np.argsort(-width, kind="stable")
    order = order[m[order] > 0]
    words = np.cumsum(-(-m[order] // 64))
    i = 0
    while i < len(order):
        # the longest pairs left; many words, of similar widths unless they are few
        before = int(words[i - 1]) if i else 0
        wide = int(width[order[i]])
        j = int(np.searchsorted(words, before + WORDS, side="right"))
        similar = int(np.searchsorted(-width[order], -(wide * 4 // 5), side="right"))
        j = min(j, max(similar, int(np.searchsorted(words, before + FEW))), i + STATE // wide)
        some = order[i:max(j, i + 1)]
        some = some[np.argsort(-m[some], kind="stable")]
        short = [a[k] if la[k] <= lb[k] else b[k] for k in some]
        long = [b[k] if la[k] <= lb[k] else a[k] for k in some]
        out[some] = _wavefront(short, long, m[some], width[some])
        i += len(some)
    return out


def _wavefront(short, long, m, width) -> np.ndarray:
    """Distances of pairs in descending order of ``m``, the length of the
    shorter string; ``width``: that of the longer one."""
    pairs, columns = len(short), int(width.max())
    rows = -(-m // 64)
    deep = int(rows[0])
    letters, coded = np.unique(np.concatenate(short), return_inverse=True)
    size = len(letters) + 1  # and one for characters that no shorter string has
    flat = np.concatenate(long)
    at = np.searchsorted(letters, flat)
    known = letters[np.minimum(at, len(letters) - 1)] == flat
    stride = columns + deep
    text = np.full((pairs, stride), size - 1, dtype=np.int64)
    text[:, deep:][np.arange(columns)[None, :] < width[:, None]] = np.where(known, at, size - 1)
    text = text.reshape(-1)
    # words by their row in the pair, then by pair: the pairs that have row w come first
    count = np.searchsorted(-rows, -np.arange(deep), side="left")  # pairs with more than w words
    starts = np.concatenate([[0], np.cumsum(count)])
    total = int(starts[-1])
    row = np.repeat(np.arange(deep), count)
    pair = np.arange(total) - starts[row]
    above = starts[row - 1] + pair  # the word above (not used in row 0)
    masks = np.zeros(total * size, dtype=np.uint64)
    begins = np.concatenate([[0], np.cumsum(m)])[:-1]
    for bit in range(64):
        has = np.flatnonzero(row * 64 + bit < m[pair])
        if not len(has):
            break
        masks[has * size + coded[begins[pair[has]] + row[has] * 64 + bit]] |= _ONE << np.uint64(bit)
    base = np.arange(total) * size
    place = pair * stride + deep - row  # + t: where the word's letter of step t stands
    final = starts[rows - 1] + np.arange(pairs)
    top = np.full(total, 63, dtype=np.uint64)
    top[final] = (m - 1) % 64
    score = m.copy()
    vp, vm = np.full(total, _ALL), np.zeros(total, dtype=np.uint64)
    up, down = np.ones(total, dtype=np.uint64), np.zeros(total, dtype=np.uint64)  # horizontal differences that leave
    whole = np.empty((6, total), dtype=np.uint64)
    where, letter = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int64)
    first = int(count[0])
    for t in range(columns + deep - 1):
        live = int(starts[min(t + 1, deep)])
        pv, mv, eq, xv, xh, ph, hp, hm = vp[:live], vm[:live], *whole[:, :live]
        index, symbol = where[:live], letter[:live]
        np.add(place[:live], t, out=index)
        text.take(index, out=symbol, mode="clip")
        symbol += base[:live]
        masks.take(symbol, out=eq, mode="clip")
        hp[:first], hm[:first] = 1, 0  # row 0 grows by one a column
        if live > first:
            up.take(above[first:live], out=hp[first:], mode="clip")
            down.take(above[first:live], out=hm[first:], mode="clip")
        np.bitwise_or(eq, mv, out=xv)
        eq |= hm
        np.bitwise_and(eq, pv, out=xh)
        xh += pv
        xh ^= pv
        xh |= eq
        np.bitwise_or(xh, pv, out=ph)
        np.invert(ph, out=ph)
        ph |= mv
        xh &= pv  # now the negative horizontal differences
        shift = top[:live]
        np.right_shift(ph, shift, out=up[:live])
        up[:live] &= _ONE
        np.right_shift(xh, shift, out=down[:live])
        down[:live] &= _ONE
        j = t - rows + 1
        score += (up[final].view(np.int64) - down[final].view(np.int64)) * ((j >= 0) & (j < width))
        ph <<= _ONE
        ph |= hp
        xh <<= _ONE
        xh |= hm
        np.bitwise_or(xv, ph, out=pv)
        np.invert(pv, out=pv)
        pv |= xh
        np.bitwise_and(ph, xv, out=mv)
    return score


def pair_distances(a, b) -> np.ndarray:
    """Distances of pairs of strings (lists of equal length, without nulls)."""
    return distances([code_points(x) for x in a], [code_points(x) for x in b])


# --- many texts against few ---------------------------------------------------------

#: Texts side by side at least, words of a block, and words of letter masks held at once, at most.
LANES, BLOCK, MASKS = 24, 4096, 1 << 24


class Patterns:
    """Texts of similar lengths, their rows of 64 characters below each other:
    arrays (row, text). ``letters``: sorted code points; one more stands for all
    others and has no bits."""

    def __init__(self, points: list[np.ndarray], letters: np.ndarray):
        self.letters, self.count, self.kinds = letters, len(points), len(letters) + 1
        size = np.array([len(p) for p in points], dtype=np.int64)
        self.rows = max(1, -(-int(size.max()) // 64))
        flat = np.concatenate(points)
        lane = np.repeat(np.arange(self.count), size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        place = ((at // 64) * self.kinds + self.codes(flat)) * self.count + lane
        masks = np.zeros(self.rows * self.kinds * self.count, dtype=np.uint64)
        by = np.argsort(at % 64, kind="stable")
        place, bits = place[by], np.searchsorted((at % 64)[by], np.arange(65))
        for bit in range(64):
            masks[place[bits[bit]:bits[bit + 1]]] |= _ONE << np.uint64(bit)
        self.masks = masks.reshape(self.rows * self.kinds, self.count)
        self.masks[self.kinds - 1::self.kinds] = 0
        left = np.clip(size[None, :] - 64 * np.arange(self.rows)[:, None], 0, 64)
        self.valid = np.where(left == 64, _ALL, (_ONE << (left % 64).astype(np.uint64)) - _ONE)

    def codes(self, text: np.ndarray) -> np.ndarray:
        code = np.searchsorted(self.letters, text)
        known = code < len(self.letters)
        known[known] = self.letters[code[known]] == text[known]
        return np.where(known, code, len(self.letters))

    def distances(self, text: np.ndarray) -> np.ndarray:
        """Distances of all texts to ``text``; row r is r columns behind the first."""
        deep, m = self.rows, len(text)
        shape = (deep, self.count)
        code = self.codes(text)[::-1].copy()
        base = np.arange(deep) * self.kinds
        vps, vms = np.full(shape, _ALL), np.zeros(shape, dtype=np.uint64)
        eqs, hs, ps = (np.empty(shape, dtype=np.uint64) for _ in range(3))
        # horizontal differences that enter each row, ``ups`` inverted; the first row grows by one a column
        ups, downs = ([np.zeros((deep + 1, self.count), dtype=np.uint64) for _ in range(2)] for _ in range(2))
        last = np.uint64(63)
        for t in range(m + deep - 1):
            low, high = max(0, t - m + 1), min(deep, t + 1)
            vp, vm, eq, h, p = vps[low:high], vms[low:high], eqs[low:high], hs[low:high], ps[low:high]
            down = downs[t % 2][low:high]
            self.masks.take(base[low:high] + code[m - 1 - t + low:m - 1 - t + high], axis=0, out=eq, mode="clip")
            np.bitwise_or(eq, down, out=eq)
            np.bitwise_and(eq, vp, out=h)
            np.add(h, vp, out=h)
            np.bitwise_xor(h, vp, out=h)
            np.bitwise_or(h, eq, out=h)
            np.bitwise_or(h, vm, out=h)  # 1: the diagonal does not grow
            np.bitwise_or(h, vp, out=p)
            np.bitwise_xor(p, vm, out=p)  # 0: grows to the right
            np.bitwise_and(h, vp, out=eq)  # 1: shrinks to the right
            np.right_shift(p, last, out=ups[1 - t % 2][low + 1:high + 1])
            np.right_shift(eq, last, out=downs[1 - t % 2][low + 1:high + 1])
            np.left_shift(p, _ONE, out=p)
            np.bitwise_or(p, ups[t % 2][low:high], out=p)
            np.left_shift(eq, _ONE, out=eq)
            np.bitwise_or(eq, down, out=eq)
            np.bitwise_or(h, p, out=vp)
            np.bitwise_xor(vp, p, out=vm)
            np.bitwise_xor(vp, h, out=vp)
            np.bitwise_or(vp, eq, out=vp)
        plus, minus = (np.bitwise_count(v & self.valid).sum(axis=0, dtype=np.int64) for v in (vps, vms))
        return m + plus - minus


class Long:
    """One text whose rows are the bits of whole numbers."""

    def __init__(self, points: np.ndarray, letters: np.ndarray):
        self.size = len(points)
        self.masks = {c: int.from_bytes(np.packbits(points == c, bitorder="little").tobytes(), "little")
                      for c in np.intersect1d(points, letters).tolist()}

    def distance(self, text: np.ndarray) -> int:
        full = (1 << self.size) - 1
        vp, vm = full, 0
        for c in text.tolist():
            eq = self.masks.get(c, 0)
            x = eq | vm
            h = (((eq & vp) + vp) ^ vp) | eq
            p = ((vm | (full ^ ((h | vp) & full))) << 1) | 1
            m = (vp & h) << 1
            vp = (m | (full ^ ((x | p) & full))) & full
            vm = p & x & full
        return len(text) + vp.bit_count() - vm.bit_count()


class Many:
    """Texts to be measured against some of the texts ``others`` (code points)."""

    def __init__(self, points: list[np.ndarray], others: list[np.ndarray]):
        self.points, self.long, self.blocks = points, {}, []
        self.letters = np.unique(np.concatenate(others)) if others else np.zeros(0, dtype=np.uint32)
        size = np.array([len(p) for p in points], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        rows = np.maximum(1, -(-size[order] // 64))
        self.alone, i = np.zeros(len(points), dtype=bool), 0
        while i < len(points):
            similar = int(np.searchsorted(-rows, -(int(rows[i]) * 4 // 5), side="right"))
            some = order[i:min(similar, i + max(LANES, BLOCK // int(rows[i])))]
            if len(some) < LANES:
                self.alone[some] = True
            else:
                self.blocks.append((some, Patterns([points[k] for k in some], self.letters)))
            i += len(some)

    def distances(self, text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Distances to ``text`` of the texts with the indices ``wanted``."""
        ask = np.zeros(len(self.points), dtype=bool)
        ask[wanted] = True
        alone = ask & self.alone
        out = np.zeros(len(self.points), dtype=np.int64)
        for some, block in self.blocks:
            if ask[some].sum() < LANES:
                alone[some] |= ask[some]
            else:
                out[some] = block.distances(text)
        for k in np.flatnonzero(alone).tolist():
            if k not in self.long:
                self.long[k] = Long(self.points[k], self.letters)
            out[k] = self.long[k].distance(text)
        return out[wanted]


def pieces(size: np.ndarray, others: list[np.ndarray]) -> list[np.ndarray]:
    """Indices of texts in pieces whose letter masks are held at once."""
    letters = len(np.unique(np.concatenate(others))) + 1 if others else 1
    return np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum((size // 64 + 1) * letters) // MASKS)) + 1)


# --- nearest originals ------------------------------------------------------------

#: Pairs measured in one call, about, and originals that each meet all texts at once, at most.
PAIRS, FEW_ORIGINALS = 1 << 17, 64


def _spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of all integers in the ranges [starts, stops)."""
    n = np.maximum(0, stops - starts)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


class Originals:
    """Originals of one group in the order of their lengths."""

    def __init__(self, texts: list[str], pos: list[int | None]):
        by = sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
        self.texts = [texts[i] for i in by]
        self.points = [code_points(t) for t in self.texts]
        self.size = np.array([len(p) for p in self.points], dtype=np.int64)
        self.pos = [pos[i] for i in by]
        # of equally near ones the smallest position counts (null before any number), then the text
        order = sorted(range(len(by)), key=lambda i: (self.pos[i] is not None, self.pos[i] or 0, self.texts[i]))
        self.rank = np.empty(len(by), dtype=np.int64)
        self.rank[order] = np.arange(len(by))

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distance to, and index of, the nearest original of each text.

        A text meets the originals from its own length outwards, in windows
        that double; those whose lengths differ by more than its best distance
        so far are never measured, and a text is done when its window reaches
        them on both sides."""
        points = [code_points(t) for t in texts]
        size = np.array([len(p) for p in points], dtype=np.int64)
        n, count = len(texts), len(self.texts)
        best, at = np.full(n, np.iinfo(np.int64).max // 4), np.full(n, -1)
        if count <= FEW_ORIGINALS:
            for some in pieces(size, self.points):
                many = Many([points[k] for k in some], self.points)
                for w, text in enumerate(self.points):
                    r = np.flatnonzero(np.abs(size[some] - len(text)) <= best[some])
                    d = many.distances(text, r)
                    r = some[r]
                    better = (d < best[r]) | ((d == best[r]) & (self.rank[w] < self.rank[at[r]]))
                    best[r[better]], at[r[better]] = d[better], w
            return best, at
        middle = np.searchsorted(self.size, size)
        live, reach = np.arange(n), 0
        while len(live):
            wide = max(2, 2 * reach)
            low = np.searchsorted(self.size, size[live] - best[live], side="left")
            high = np.searchsorted(self.size, size[live] + best[live], side="right")
            mid = middle[live]
            left = _spans(np.maximum(low, mid - wide), np.maximum(0, mid - reach))
            right = _spans(np.minimum(count, mid + reach), np.minimum(high, mid + wide))
            row, which = (np.concatenate([live[a[k]] if k == 0 else a[k] for a in (left, right)]) for k in (0, 1))
            for i in range(0, len(row), PAIRS):
                r, w = row[i:i + PAIRS], which[i:i + PAIRS]
                d = distances([points[x] for x in r], [self.points[x] for x in w])
                order = np.lexsort((self.rank[w], d, r))
                first = order[np.concatenate([[True], r[order][1:] != r[order][:-1]])]
                r, w, d = r[first], w[first], d[first]
                better = (d < best[r]) | ((d == best[r]) & (self.rank[w] < self.rank[at[r]]))
                best[r[better]], at[r[better]] = d[better], w[better]
            reach = wide
            mid = middle[live]
            more_left = (mid > reach) & (size[live] - self.size[np.maximum(0, mid - reach - 1)] <= best[live])
            more_right = (mid + reach < count) & (
                self.size[np.minimum(count - 1, mid + reach)] - size[live] <= best[live])
            live = live[more_left | more_right]
        return best, at


class Prefixes:
    """The originals of nested splits: per run in the order of their ranks."""

    def __init__(self, rows: list[tuple]):
        """rows: (run, rank, text to measure, position, own text)."""
        self.runs = sorted({r[0] for r in rows})
        self.of = {run: sorted(r[1:] for r in rows if r[0] == run) for run in self.runs}
        self.points = {run: [code_points(r[1]) for r in of] for run, of in self.of.items()}

    def nearest(self, texts: list[str], sizes: list[int]) -> dict:
        """(run, size) -> (distance, index in the run) over the run's first
        ``size`` originals. An original is measured unless its length alone
        rules it out."""
        points = [code_points(t) for t in texts]
        others = [p for of in self.points.values() for p in of]
        found = [self._nearest([points[k] for k in some], others, sizes)
                 for some in pieces(np.array([len(p) for p in points], dtype=np.int64), others)]
        return {key: tuple(np.concatenate([f[key][i] for f in found]) for i in (0, 1)) for key in found[0]}

    def _nearest(self, points: list[np.ndarray], others: list[np.ndarray], sizes: list[int]) -> dict:
        own = np.array([len(p) for p in points], dtype=np.int64)
        n, many, out = len(points), Many(points, others), {}
        for run, of in self.of.items():
            best, at = np.full(n, np.iinfo(np.int64).max // 4), np.full(n, -1)
            place = [(x[2] is not None, x[2] or 0) for x in of]
            for k, text in enumerate(self.points[run]):
                r = np.flatnonzero(np.abs(own - len(text)) <= best)
                mine = many.distances(text, r)
                tie = np.array([*(place[k] < x for x in place), False])[at[r]]
                better = (mine < best[r]) | ((mine == best[r]) & tie)
                best[r[better]], at[r[better]] = mine[better], k
                last = k + 1 == len(of)
                for size in sizes:
                    if size == k + 1 or (last and size > k):
                        out[run, size] = best.copy(), at.copy()
        return out
