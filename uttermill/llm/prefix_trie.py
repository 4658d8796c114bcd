"""Prefix trie of conversations in balanced parentheses.

Turns become 16-byte digests of (role, text), a conversation the row of its
digests. Conversations are sorted by that row (then by id) and dealt by range;
a shard is one range, and its trie is written as balanced parentheses: "(" on
entering a node in preorder, ")" on leaving it. On this string

- the excess (opens minus closes) in blocks with their minima, and a tree of
  minima above them, gives findclose, which delimits a node's subtree,
- the rank of "()" counts the leaves of a subtree,
- cumulative arrays over the preorder give conversations and saved tokens.

Since the order is lexicographic, neighbouring shards share only the nodes on
the common prefix of the last and the first conversation beside their border
(their spines). Those nodes are summed over the shards. What two shards count
twice follows from the border alone: of the shared prefix, the nodes' own
bytes, the child on the way down, and the leaf at its end if the left shard's
last conversation ends there.

Rows with a null conversation id belong to no conversation. Turns are ordered
by number, null first, ties by digest; null role or text is empty; repeated
rows are turns of their own; extra columns are ignored; an empty table has no
nodes. A conversation's digests (24 bytes a turn) travel as one row; texts are
never shuffled, and equal conversations, however many, are spread over shards.
"""

from __future__ import annotations

from hashlib import md5, sha256
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ..session import broadcast_if_small
from .common import release_memory, written

#: Turns of a shard, about.
SHARD_TURNS = 250_000
#: Positions of a block of the excess.
BLOCK = 256
#: Ids of a piece in which a shard hands on the ids that end at a shared node.
PIECE_IDS = 200
DIGEST = 16

NODE = ("node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string, spine boolean, spine_parent boolean, "
        "piece long, ids string")


# --- sequences of digests -------------------------------------------------------

def turn_digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<d: binary, n: bigint>>): the digest and
    the text's UTF-8 bytes of each turn, in order."""
    t = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("t"),
        turn_digest(F.col(f"`{role}`"), F.col(f"`{text}`")).alias("d"),
        F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long").alias("n"))
    return t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "d", "n"))),
                                                lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"))).alias("turns"))


def with_shared_starts(seqs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c rebuilt: the first h turns of conversation c - c
    mod ``every`` (all if fewer, none if absent), then c's own turns after its
    first h; h = unsigned crc32 of c's decimal digits mod ``most``."""
    whole = seqs.where(F.pmod("conv_id", F.lit(every)) == 0).select(
        F.col("conv_id").alias("_first"), F.slice("turns", 1, most - 1).alias("_start"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    none = F.array().cast(dict(seqs.dtypes)["turns"])
    return (seqs.withColumn("_first", F.col("conv_id") - F.pmod("conv_id", F.lit(every)))
            .join(whole, "_first", "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("_start", none), F.lit(1), h),
                                        F.slice("turns", h + 1, F.size("turns"))).alias("turns")))


# --- balanced parentheses ---------------------------------------------------------

class Parentheses:
    """A balanced sequence (1 open, 0 close) with range-minimum blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.opens = np.flatnonzero(bits == 1)
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        pad = -len(bits) % BLOCK
        # behind the end: lower than any excess, so that every search ends
        rows = np.concatenate([self.excess, np.full(pad, -1)]).reshape(-1, BLOCK)
        self.rows = rows
        self.minima = [rows.min(axis=1)]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            low = np.concatenate([low, np.full(len(low) % 2, np.iinfo(np.int64).max)])
            self.minima.append(low.reshape(-1, 2).min(axis=1))

    def _first_below(self, at: np.ndarray, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First position after ``at`` within ``block`` with an excess of at
        most ``target``; -1 if there is none."""
        out = np.full(len(at), -1)
        for i in range(0, len(at), 4096):
            b, s = block[i:i + 4096], slice(i, i + 4096)
            hit = (self.rows[b] <= target[s, None]) & (np.arange(BLOCK)[None, :] + (b * BLOCK)[:, None] > at[s, None])
            found = hit.any(axis=1)
            out[s] = np.where(found, b * BLOCK + hit.argmax(axis=1), -1)
        return out

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Position of the ")" of each "(" at ``at``."""
        target = self.excess[at] - 1
        out = self._first_below(at, at // BLOCK, target)
        rest = np.flatnonzero(out < 0)
        if not len(rest):
            return out
        # up the tree of minima until a node to the right holds the target, then down to its first block
        node, t = at[rest] // BLOCK, target[rest]
        level = np.zeros(len(rest), dtype=np.int64)
        found = np.full(len(rest), -1)
        for k, minima in enumerate(self.minima):
            live = found < 0
            right = node + 1
            ok = live & (node % 2 == 0) & (right < len(minima))
            ok[ok] = minima[right[ok]] <= t[ok]
            found[ok], level[ok] = right[ok], k
            node = node // 2
        for k in range(len(self.minima) - 1, 0, -1):
            down = level == k
            left = found[down] * 2
            found[down] = np.where(self.minima[k - 1][left] <= t[down], left, left + 1)
            level[down] = k - 1
        out[rest] = self._first_below(at[rest], found, t)
        return out

    def leaf_rank(self) -> np.ndarray:
        """Number of "()" pairs that begin before each position."""
        pair = np.zeros(len(self.bits) + 1, dtype=np.int64)
        pair[1:-1] = (self.bits[:-1] == 1) & (self.bits[1:] == 0)
        return np.cumsum(pair)


def common_turns(a: bytes, b: bytes) -> int:
    """Number of leading digests that two rows of digests share."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * DIGEST:mid * DIGEST] == b[low * DIGEST:mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


class Shard:
    """The trie of conversations sorted by (key, id)."""

    def __init__(self, keys: list[bytes], ids: list[int], sizes: list):
        bits, weight, parent, digests, ends = bytearray(), [0], [-1], [md5(b"")], []
        bits.append(1)
        path, before = [0], b""
        for key, size in zip(keys, sizes):
            if key != before:
                shared = common_turns(before, key)
                bits += b"\0" * (len(path) - 1 - shared)
                del path[shared + 1:]
                for d in range(shared, len(key) // DIGEST):
                    bits.append(1)
                    h = digests[path[-1]].copy()
                    h.update(key[d * DIGEST:(d + 1) * DIGEST])
                    digests.append(h)
                    parent.append(path[-1])
                    path.append(len(weight))
                    weight.append(int(size[d]))
                before = key
            ends.append(path[-1])
            if len(ends) == 1:
                self.first_path = list(path)
        self.last_path = path
        bits += b"\0" * len(path)
        self.ids, self.ends = np.array(ids, dtype=np.int64), np.array(ends, dtype=np.int64)
        self.weight, self.parent = np.array(weight, dtype=np.int64), np.array(parent, dtype=np.int64)
        self.digest = [h.digest() for h in digests]
        n = len(weight)
        bp = Parentheses(np.frombuffer(bytes(bits), dtype=np.uint8))
        close = bp.findclose(bp.opens)
        node = np.arange(n)
        after = node + (close - bp.opens + 1) // 2  # subtrees are runs of the preorder
        self.depth = bp.excess[bp.opens] - 1
        rank = bp.leaf_rank()
        self.leaves = rank[close] - rank[bp.opens]
        own = np.concatenate([[0], np.cumsum(np.bincount(self.ends, minlength=n))])
        self.convs = own[after] - own[node]
        saved = np.concatenate([[0], np.cumsum((self.convs - 1) * self.weight)])
        self.saved = saved[after] - saved[node]
        self.children = np.bincount(self.parent[1:], minlength=n)
        smallest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(smallest, self.ends, self.ids)
        low = smallest.tolist()
        for v in range(n - 1, 0, -1):
            if low[v] < low[parent[v]]:
                low[parent[v]] = low[v]
        self.smallest = np.array(low, dtype=np.int64)


EMPTY = sha256(b"").hexdigest()


def shard_nodes(shard: Shard, left: int, right: int, ended: bool) -> pa.Table:
    """Rows of NODE. ``left``, ``right``: turns that the shard's first (last)
    conversation shares with its neighbour, -1 without one; ``ended``: the
    last one has no more turns than that. Shared nodes get partial sums."""
    n = len(shard.weight)
    spine = np.zeros(n, dtype=bool)
    spine[shard.first_path[:left + 1]] = True
    children, leaves, saved = shard.children.copy(), shard.leaves.copy(), shard.saved.copy()
    if right >= 0:  # what the next shard counts too
        path = np.array(shard.last_path[:right + 1])
        spine[path] = True
        children[path[:-1]] -= 1
        leaves[path] -= int(ended)
        saved[path] += np.cumsum(shard.weight[path][::-1])[::-1]
    by = np.argsort(shard.ends, kind="stable")  # ids stay ascending
    at = np.searchsorted(shard.ends[by], np.arange(n + 1))
    ids = shard.ids[by]
    digest, pieces = [EMPTY] * n, []
    for v in np.flatnonzero(np.diff(at)).tolist():
        own = ids[at[v]:at[v + 1]]
        if spine[v]:
            for i in range(0, len(own), PIECE_IDS):
                pieces.append((v, int(own[i]), ",".join(map(str, own[i:i + PIECE_IDS].tolist()))))
        else:
            digest[v] = sha256(",".join(map(str, own.tolist())).encode()).hexdigest()
    up = np.maximum(shard.parent, 0)
    nodes = pa.table({
        "node": pa.array(shard.digest, pa.binary()),
        "parent": pa.array([shard.digest[p] if p >= 0 else None for p in shard.parent.tolist()], pa.binary()),
        "conv_id": shard.smallest, "depth": shard.depth,
        "parent_conv_id": pa.array(shard.smallest[up], mask=shard.parent < 0),
        "n_convs": shard.convs, "n_children": children.astype(np.int64), "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": pa.array(digest, pa.string()), "spine": spine,
        "spine_parent": spine[up] & (shard.parent >= 0),
        "piece": pa.nulls(n, pa.int64()), "ids": pa.nulls(n, pa.string())})
    if not pieces:
        return nodes
    more = {c: pa.nulls(len(pieces), nodes.schema.field(c).type) for c in nodes.column_names}
    more |= {"node": pa.array([shard.digest[v] for v, _, _ in pieces], pa.binary()),
             "piece": pa.array([p for _, p, _ in pieces], pa.int64()),
             "ids": pa.array([x for _, _, x in pieces], pa.string())}
    return pa.concat_tables([nodes, pa.table(more, schema=nodes.schema)])


# --- all shards -----------------------------------------------------------------

@pandas_udf(LongType())
def shared_turns(a, b):
    import pandas as pd
    return pd.Series([common_turns(bytes(x), bytes(y)) if x is not None and y is not None else -1
                      for x, y in zip(a, b)], dtype="int64")


def borders(dealt: DataFrame) -> DataFrame:
    """(shard, left, right, ended) of every shard: one row a shard."""
    ends = dealt.groupBy("shard").agg(F.min(F.struct("key", "conv_id"))["key"].alias("first"),
                                      F.max(F.struct("key", "conv_id"))["key"].alias("last"))
    w = Window.orderBy("shard")
    near = ends.select("shard", "last", F.lead("first").over(w).alias("next"))
    right = written(near.select("shard", shared_turns("last", "next").alias("right"),
                                F.octet_length("last").alias("size")), "borders")
    return right.select("shard", F.coalesce(F.lag("right").over(w), F.lit(-1)).alias("left"), "right",
                        (F.col("size") == F.col("right") * DIGEST).alias("ended"))


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of all pieces of a node in order; reads them as a stream."""
    node, h = None, None
    done: list[tuple[bytes, str]] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()),
                                           pa.array([x for _, x in done], pa.string())], ["node", "digest"])
    for batch in batches:
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if n != node:
                if h:
                    done.append((node, h.hexdigest()))
                node, h = n, sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if len(done) >= 10_000:
            yield out()
            done.clear()
    if h:
        done.append((node, h.hexdigest()))
    yield out()


def trie(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of ``seqs`` (conv_id, turns as of ``sequences``):
    node and parent (digests of the turns from the root), conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = seqs.sparkSession
    rows = written(seqs.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["d"])), "")).alias("key"),
        F.transform("turns", lambda x: x["n"]).alias("sizes")), "sequences")
    total = rows.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(-(-total // shard_turns), min(spark.sparkContext.defaultParallelism, 1 + total // 2000))
    dealt = written(rows.repartitionByRange(int(shards), "key", "conv_id").withColumn(
        "shard", F.spark_partition_id()), "shards")

    def build(part: pa.Table) -> pa.Table:
        keys, ids = part["key"].to_pylist(), part["conv_id"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (keys[i], ids[i]))
        sizes = part["sizes"].to_pylist()
        shard = Shard([keys[i] for i in order], [ids[i] for i in order], [sizes[i] for i in order])
        one = {c: part[c][0].as_py() for c in ("left", "right", "ended")}
        nodes = shard_nodes(shard, one["left"], one["right"], one["ended"])
        release_memory()
        return nodes

    found = written(dealt.join(F.broadcast(borders(dealt)), "shard")  # one row a shard
                    .groupBy("shard").applyInArrow(build, NODE), "nodes")
    cols = ["node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", "ends_sha256"]
    nodes = found.where(F.col("ids").isNull())
    ends = (found.where(F.col("ids").isNotNull()).select("node", "piece", "ids")
            .repartition("node").sortWithinPartitions("node", "piece")
            .mapInArrow(joined_ids, "node binary, digest string"))
    spine = nodes.where("spine").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"),
        *[f(c).alias(c) for f, c in ((F.min, "conv_id"), (F.sum, "n_convs"), (F.sum, "n_children"),
                                     (F.sum, "n_leaves"), (F.sum, "saved_tokens"))])
    spine = written(spine.join(ends, "node", "left")
                    .withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY))).drop("digest"), "spine")
    above = broadcast_if_small(spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    own = nodes.where(~F.col("spine"))
    return (own.where(~F.col("spine_parent")).select(cols)
            .unionByName(own.where("spine_parent").drop("parent_conv_id").join(above, "parent").select(cols))
            .unionByName(spine.join(above, "parent", "left").select(cols)))
