"""Nearest words by cosine through an inverted file (EXP-3).

Centroids are fitted by spherical k-means on at most ``SAMPLE`` vectors (those
with the smallest word hashes); every vocabulary vector is in the list of its
nearest centroid. Words ask in two steps:

1. each visits the ``probes`` lists with the nearest centroids, which gives
   its n-th best similarity so far;
2. with ``exact``, it then visits every other list that can still hold a better
   word: members of a list are within an angle r of its centroid, so none has
   a cosine above cos(angle(word, centroid) - r).

So the result with ``exact`` is that of comparing all words, and without it
the first step's, whose recall ``recall`` measures. Words and members are dealt
to blocks of bounded size, list by list; a word meets the blocks that hold a
list it visits, and every pair of blocks is a task that hands on at most n rows
a word. In a task (``closest``) products of single floats, whose error has a
bound, leave out all pairs below the n best known so far; the few others are
measured in doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import unit
from ..session import broadcast_if_small, materialize

#: Vectors on which centroids are fitted, lists, and lists visited first, at most.
SAMPLE, LISTS, PROBES = 16_384, 1_024, 32
#: Vectors of either side in a block, and pairs of blocks with a partition each (more are dealt by hash).
BLOCK, PAIRS = 65_536, 4_096
#: Words and members multiplied at once, pairs held before they are measured, rows of an Arrow batch taken at once.
ROWS, COLS, HELD, SLICE = 512, 1_024, 1 << 18, 2_048


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _slices(batches):
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _bits(flags: np.ndarray) -> pa.Array:
    """Rows of flags as binary values."""
    packed = np.packbits(flags, axis=1)
    ends = np.arange(len(packed) + 1, dtype=np.int32) * packed.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(ends), pa.py_buffer(packed)])


def _flags(column, width: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1, count=width).astype(bool)


def fit_centroids(sample: np.ndarray, lists: int, steps: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(42)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(steps):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def _first(near: np.ndarray, size: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` lists nearest to each word (word, list), by its cosines to the centroids."""
    some = np.flatnonzero(size > 0)
    visit = np.zeros(near.shape, dtype=bool)
    if len(some) <= probes:
        visit[:, some] = True
    else:
        order = np.argpartition(-near[:, some], probes - 1, axis=1)[:, :probes]
        visit[np.arange(len(near))[:, None], some[order]] = True
    return visit


def _others(near: np.ndarray, angle: np.ndarray, size: np.ndarray, seen: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The lists not ``seen`` whose members can have a cosine of ``least`` (NaN: any)."""
    near = np.clip(near, -1, 1)
    limit = np.sqrt(1 - near * near) * np.sin(angle) + near * np.cos(angle)  # cos(angle to the centroid - angle)
    limit[near >= np.cos(angle)] = 1
    return ~seen & (size > 0) & ~(limit + 1e-9 < least[:, None])  # NaN: no bound


def _top(sims: np.ndarray, least: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n largest of each row (of equal ones the first
    columns), none below ``least`` and only finite ones."""
    many = np.flatnonzero((sims >= least[:, None]).sum(axis=1) > n)
    if len(many) and sims.shape[1] > n:
        at = sims.shape[1] - n
        last = least.copy()
        last[many] = np.maximum(least[many], np.partition(sims[many], at, axis=1)[:, at])
        least = last
    hit = (sims >= least[:, None]) & (sims > -np.inf)
    for r in np.flatnonzero(hit.sum(axis=1) > n):  # equal ones at the end
        hit[r, np.flatnonzero(hit[r] & (sims[r] == least[r]))[n - int((sims[r] > least[r]).sum()):]] = False
    return np.nonzero(hit)


def _distinct(order: np.ndarray, vecs: np.ndarray, of: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """``order`` (places of members by their words) without those that n + 1
    smaller words with the same list and vector go before."""
    first = vecs[order, 0]
    by = np.argsort(first, kind="stable")
    same = first[by[1:]] == first[by[:-1]]
    if not same.any():
        return order
    at = np.sort(by[np.append(same, False) | np.append(False, same)])
    some = order[at]
    rows = np.column_stack([vecs[some], of[some]])
    group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    by = np.argsort(group, kind="stable")
    group, word = group[by], code[some[by]]
    begins = np.append(True, group[1:] != group[:-1])
    words = np.cumsum(begins | np.append(True, word[1:] != word[:-1]))
    return np.delete(order, at[by[words - words[begins][np.cumsum(begins) - 1] > n]])


def _tiles(of: np.ndarray, alone: bool):
    """(first and end column, first and end list) of columns in the order of
    their lists: whole lists side by side up to ``COLS`` (or each ``alone``),
    longer ones cut."""
    begin = at = 0
    for end in np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)).tolist():
        if at > begin and (alone or end - begin > COLS):
            yield begin, at, of[begin], of[at - 1] + 1
            begin = at
        while end - begin > COLS:
            yield begin, begin + COLS, of[begin], of[begin] + 1
            begin += COLS
        at = end
    yield begin, at, of[begin], of[at - 1] + 1


def closest(names, mine: np.ndarray, visit: np.ndarray, words, vecs: np.ndarray, of: np.ndarray, n: int,
            least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``names``, place in ``words``, cosine) of the n nearest of each
    name (unit vectors ``mine``) among the words (``vecs``, of list ``of``) of the
    lists that it visits (name, list), of equal ones the smaller words, the name
    itself left out. With ``least`` (NaN: any) only those that reach it, and none
    that n words of lists not visited are nearer than."""
    asks = np.flatnonzero(np.isfinite(mine).all(axis=1) & visit.any(axis=1))
    order = pc.sort_indices(words).to_numpy()
    order = order[np.isfinite(vecs).all(axis=1)[order]]
    none = np.zeros(0, dtype=np.int64)
    if not len(asks) or not len(order):
        return none, none, np.zeros(0)
    code = pc.dictionary_encode(pa.concat_arrays([names, words]), null_encoding="encode").indices.to_numpy()
    code, own = code[:len(names)], code[len(names):]
    order = _distinct(order, vecs, of, own, n)
    rank = np.argsort(of[order], kind="stable")  # by list; of equal similarities the smaller rank counts
    order = order[rank]
    visit, code, of, own = visit[asks], code[asks], of[order], own[order]
    low, low_vecs = mine.astype(np.float32)[asks], vecs.astype(np.float32)[order]
    # how far a product of single floats can be off, of vectors no longer than 1
    off = (vecs.shape[1] + 8) * 2.0 ** -23
    bound = np.full(len(asks), -np.inf)
    if least is not None:
        bound = np.where(np.isnan(least[asks]), -np.inf, least[asks] - 1e-9)
    reach = (bound - 2 * off).astype(np.float32)
    enough = n + int(np.bincount(own).max())  # the word itself may be among them
    best = none, none, np.zeros(0)

    def measure(r: np.ndarray, c: np.ndarray) -> None:
        nonlocal best
        some = (code[r] != own[c]) & visit[r, of[c]]
        r, c = r[some], c[some]
        sims = np.empty(len(r))
        for i in range(0, len(r), 16_384):
            sims[i:i + 16_384] = np.einsum("ij,ij->i", mine[asks[r[i:i + 16_384]]], vecs[order[c[i:i + 16_384]]])
        some = sims >= bound[r]
        r, c, sims = (np.concatenate(x) for x in zip(best, (r[some], c[some], sims[some])))
        at = np.lexsort((rank[c], -sims, r))
        r = r[at]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        at, r, last = at[place < n], r[place < n], place[place < n] == n - 1
        best = r, c[at], sims[at]
        reach[r[last]] = np.maximum(reach[r[last]], best[2][last] - 2 * off)

    held, count = [], 0
    for begin, end, one, after in _tiles(of, alone=least is None):
        rows = np.flatnonzero(visit[:, one:after].any(axis=1))
        side = low_vecs[begin:end].T
        for i in range(0, len(rows), ROWS):
            r = rows[i:i + ROWS]
            sims = low[r] @ side
            hit = sims >= reach[r, None]
            if end - begin > enough and np.count_nonzero(hit) > 4 * enough * len(r):
                # so many of the row are no smaller than the last of the largest of groups
                groups = min(4 * enough, end - begin)
                size = (end - begin) // groups
                high = sims[:, :groups * size].reshape(len(r), size, groups).max(axis=1)
                high = high[_top(high, np.full(len(r), -np.inf), enough)].reshape(len(r), enough)
                reach[r] = np.maximum(reach[r], high.min(axis=1) - np.float32(2 * off))
                hit = sims >= reach[r, None]
            x, y = np.divmod(np.flatnonzero(hit), end - begin)
            held.append((r[x], y + begin))
            count += len(x)
            if count > HELD:
                measure(*map(np.concatenate, zip(*held)))
                held, count = [], 0
    if count:
        measure(*map(np.concatenate, zip(*held)))
    return asks[best[0]], order[best[1]], best[2]


class VectorIndex:
    """The lists of a vocabulary: ``members`` (_list, _v, _vec) and, per list,
    centroid and angle, arrays of at most ``LISTS`` rows."""

    def __init__(self, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE):
        self.spark = vectors.sparkSession
        vocab = materialize(vectors.where(F.col("vec").isNotNull() & (F.size("vec") > 0))
                            .select(F.col("word").alias("_v"), unit("vec").alias("_vec")))
        some = vocab.orderBy(F.xxhash64("_v"), "_v").limit(sample).select("_vec").collect()
        n = vocab.count()
        lists = max(1, min(LISTS, lists or round(np.sqrt(n))))
        self.centres = fit_centroids(np.array([r[0] for r in some]), lists) if some else np.zeros((0, 1))
        shared = self.spark.sparkContext.broadcast(self.centres)

        def place(batches):
            for b in _slices(batches):
                near = _matrix(b.column("_vec")) @ shared.value.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.argmax(axis=1).astype(np.int32)), pa.array(near.max(axis=1)), *b.columns],
                    ["_list", "_near", *b.schema.names])

        self.members = materialize(vocab.mapInArrow(place, "_list int, _near double, _v string, _vec array<double>"))
        self.angle, self.size = np.zeros(len(self.centres)), np.zeros(len(self.centres), dtype=np.int64)
        for which, least, count in self.members.groupBy("_list").agg(F.min("_near"), F.count(F.lit(1))).collect():
            self.angle[which], self.size[which] = np.arccos(np.clip(least, -1, 1)), count
        self.shared = self.spark.sparkContext.broadcast((self.centres, self.angle, self.size))
        self.asked: tuple | None = None

    def spans(self, size: np.ndarray, block: int) -> list[tuple[int, int, int]]:
        """(list, its first block, its blocks): whole lists of ``size`` rows side
        by side up to ``block`` rows, larger ones in blocks of their own."""
        rows, at, room = [], -1, 0
        for i, n in enumerate(size.tolist()):
            parts = -(-n // block)
            if parts > 1 or n > room:
                at, room = at + 1, block
            rows.append((i, at, max(1, parts)))
            if parts > 1:
                at, room = at + parts - 1, 0
            else:
                room -= n
        return rows

    def dealt(self, df: DataFrame, key: str, size: np.ndarray, block: int, name: str) -> tuple[DataFrame, int]:
        """``df`` (with ``_list``) with its block (``spans``; lists of several
        blocks are dealt by hash), and the number of blocks."""
        rows = self.spans(size, block)
        table = self.spark.createDataFrame(rows, "_list int, _first int, _parts int")
        df = df.join(F.broadcast(table), "_list").withColumn(
            name, F.col("_first") + F.pmod(F.xxhash64(key), "_parts").cast("int"))
        return df.drop("_first", "_parts"), max((first + parts for _, first, parts in rows), default=0)

    def best(self, words: DataFrame, n: int, rest: bool = False) -> DataFrame:
        """(_q, synonym, sim): per block of members the n nearest of each word
        (_list, _q, _vec) in the lists that it visits (_visit), the word itself
        left out; with ``rest`` only those that reach its ``_least`` (null: any).

        Blocks of words meet blocks of members, so a vector travels once per
        block of the other side, not once per list that it visits."""
        empty, lists = "_q string, synonym string, sim double", len(self.centres)
        count = np.zeros(lists, dtype=np.int64)
        for which, c in words.groupBy("_list").agg(F.count(F.lit(1))).collect():
            count[which] = c
        if not count.any():
            return self.spark.createDataFrame([], empty)
        tasks = 4 * self.spark.sparkContext.defaultParallelism
        block = int(min(BLOCK, max(512, -(-max(count.sum(), self.size.sum()) // int(np.ceil(np.sqrt(tasks)))))))
        q, nq = self.dealt(words, "_q", count, block, "_bq")
        v, nm = self.dealt(self.members.select("_list", "_v", "_vec"), "_v", self.size, block, "_bm")
        spans = [x for x in self.spans(self.size, block) if self.size[x[0]]]

        def meet(batches):
            holds = np.zeros((lists, nm), dtype=np.float32)
            for i, first, parts in spans:
                holds[i, first:first + parts] = 1
            for b in _slices(batches):
                row, which = np.nonzero(_flags(b.column("_visit"), lists).astype(np.float32) @ holds)
                ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                blocks = pa.ListArray.from_arrays(pa.array(ends), pa.array(which.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, blocks], [*b.schema.names, "_met"])

        def measure(asked, held):
            out = [pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())]
            if asked.num_rows and held.num_rows:
                names, words = asked["_q"].combine_chunks(), held["_v"].combine_chunks()
                here, of = np.unique(held["_list"].to_numpy(), return_inverse=True)
                visit = np.concatenate([_flags(asked["_visit"].slice(i, SLICE), lists)[:, here]
                                        for i in range(0, asked.num_rows, SLICE)])
                least = asked["_least"].to_numpy().astype(np.float64) if rest else None
                r, c, sims = closest(names, _matrix(asked["_vec"]), visit, words, _matrix(held["_vec"]), of, n, least)
                out = [names.take(pa.array(r)), words.take(pa.array(c)), pa.array(sims)]
            return pa.table(dict(zip(("_q", "synonym", "sim"), out)))

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q.schema)
        q = q.mapInArrow(meet, f"{fields}, _met array<int>").withColumn("_bm", F.explode("_met")).drop("_met")
        v = v.withColumn("_bq", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
        # a partition for each pair of blocks, whatever their bytes
        pair, pairs = F.col("_bm") * nq + F.col("_bq"), nq * nm
        q, v = (x.withColumn("_pair", pair).drop("_bm", "_bq") for x in (q, v))
        q, v = (x.repartitionById(pairs, "_pair") if pairs <= PAIRS else x.repartition(PAIRS, "_pair") for x in (q, v))
        return q.groupBy("_pair").cogroup(v.groupBy("_pair")).applyInArrow(measure, empty)

    def nearest(self, words: DataFrame, n: int, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """(_q, synonym, sim, rank) of the words (_q, _vec: unit vectors)."""
        w = Window.partitionBy("_q").orderBy(F.col("sim").desc(), F.col("synonym"))
        shared = self.shared

        def top(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

        def ask(batches):
            centres, angle, size = shared.value
            for b in _slices(batches):
                near = _matrix(b.column("_vec")) @ centres.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.argmax(axis=1).astype(np.int32)), *b.columns, _bits(_first(near, size, probes))],
                    ["_list", *b.schema.names, "_visit"])

        def again(batches):
            centres, angle, size = shared.value
            for b in _slices(batches):
                seen = _flags(b.column("_visit"), len(size))
                least = b.column("_least").to_numpy(zero_copy_only=False).astype(np.float64)
                visit = _others(_matrix(b.column("_vec")) @ centres.T, angle, size, seen, least)
                yield b.set_column(b.schema.get_field_index("_visit"), "_visit", _bits(visit))

        if not self.size.any():
            return self.spark.createDataFrame([], "_q string, synonym string, sim double, rank int")
        if self.asked is None or self.asked[0] is not words or self.asked[1:3] != (n, probes):
            placed = materialize(words.select("_q", "_vec").mapInArrow(
                ask, "_list int, _q string, _vec array<double>, _visit binary"))
            self.asked = words, n, probes, placed, materialize(top(self.best(placed, n)).drop("rank"))
        placed, first = self.asked[3:]  # the first step of the same words is taken once
        if not exact:
            return top(first)
        # a word with n similarities needs only lists that can reach the last of them
        least = first.groupBy("_q").agg(F.when(F.count(F.lit(1)) == n, F.min("sim")).alias("_least"))
        rest = placed.join(broadcast_if_small(least), "_q", "left").select(*placed.columns, "_least").mapInArrow(
            again, "_list int, _q string, _vec array<double>, _visit binary, _least double")
        return top(first.unionByName(self.best(rest, n, rest=True)))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the rows (_q, synonym) of ``truth`` that ``found`` has."""
    n, hit = truth.join(found.select("_q", "synonym", F.lit(1).alias("_hit")), ["_q", "synonym"], "left").agg(
        F.count(F.lit(1)), F.count("_hit")).first()
    return hit / n if n else 1.0
