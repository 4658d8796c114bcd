"""Merkle manifest of a dataset by a butterfly exchange.

Every row is a leaf: H (lowercase hex SHA-256) over its columns, each as its
UTF-8 byte count, ``:`` and its value, or ``-`` if null. The leaves of a group
(a language) stand in the order of their ids (null first; ties by the hash);
while a level has several nodes, every ``fanout`` consecutive ones (the last
run: fewer, even one) become the H of their digests in a row. What remains is
the group's subroot; the subroots in the order of the groups (null first,
bytewise) give the root likewise.

A partition is an aligned run of ``fanout ** k`` leaves of a group. One pass
hashes each partition up to its own root. Then partitions exchange, round by
round: in round r the aligned groups of ``fanout`` nodes of height r swap their
digests, every partition below a node sending to its counterparts below the
siblings (offset by offset; below a smaller sibling several partitions share
one counterpart), and each partition hashes the parent itself, redundantly. So
after the last round every partition holds the root and its siblings on all
levels, and nothing is sent down again. A second pass over the leaves
puts the partition's own levels in front.

No message list grows with a group: a partition receives at most ``fanout``
digests a round. An empty table gives an empty manifest; repeated rows are
leaves of their own; null ids come first; other columns are neither hashed nor
returned unless named in ``carry``.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import written

FANOUT = 2
#: Leaves of a partition, at most (the largest power of the fan-out up to it).
PARTITION_LEAVES = 4096
#: Rounds after which the exchange's state is written to the shared folder.
ROUNDS_A_TABLE = 6
#: Targets that one message row expands to at a time.
TARGETS = 4096

PROOF = "array<struct<at:int,others:array<string>>>"


def leaf(*columns: Column) -> Column:
    """H of the columns, each as byte count, ``:`` and value (null: ``-``)."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    def up(acc, level):
        before = F.array_join(F.slice(level["others"], F.lit(1), level["at"]), "")
        after = F.array_join(F.slice(level["others"], level["at"] + 1, F.size(level["others"])), "")
        return F.sha2(F.concat(before, acc, after), 256)
    return F.aggregate(proof, start, up)


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.flatten(F.transform(proof, lambda level: level["others"])), "")


# --- places -----------------------------------------------------------------

def numbered(df: DataFrame, order: list[str], name: str, size: str | None = None) -> DataFrame:
    """``df`` with ``n``, the row's place in ``order`` (nulls first), and with
    ``size`` also ``before``, the sum of that column over the rows before it.
    Rows are dealt by range, written in order, and numbered within their task;
    only one row a task is summed up in order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
           .withColumn("_at", F.monotonically_increasing_id()))
    own = written(own, name).withColumn("_task", F.shiftrightunsigned("_at", 33))
    amount = F.col(size) if size else F.lit(1).cast("long")
    rows = own.withColumn("_n", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    if size:
        w = Window.partitionBy("_task").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_b", F.coalesce(F.sum(size).over(w), F.lit(0)))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = (own.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"), F.sum(amount).alias("_sum"))
             .select("_task", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
                     F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum")))
    placed = rows.join(F.broadcast(tasks), "_task")  # one row a task
    more = [(F.col("_sum") + F.col("_b")).cast("long").alias("before")] if size else []
    return placed.select(*df.columns, (F.col("_rows") + F.col("_n")).alias("n"), *more)


# --- a partition's own levels -------------------------------------------------

def parents(nodes: list[str], fanout: int) -> list[str]:
    return [sha256("".join(nodes[i:i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def levels_of(leaves: list[str], whole: bool, fanout: int, height: int) -> list[list[str]]:
    """The levels of a partition's subtree; a partition that is its whole
    group stops at one node, others are hashed ``height`` times."""
    levels = [leaves]
    while len(levels[-1]) > 1 if whole else len(levels) <= height:
        levels.append(parents(levels[-1], fanout))
    return levels


def own_proof(levels: list[list[str]], i: int, fanout: int) -> list[dict]:
    out = []
    for nodes in levels[:-1]:
        first = i - i % fanout
        run = nodes[first:first + fanout]
        out.append({"at": i - first, "others": run[:i - first] + run[i - first + 1:]})
        i //= fanout
    return out


# --- the exchange ---------------------------------------------------------------

def swap(state: DataFrame) -> DataFrame:
    """One round. ``state``: part, j (the node above the partition), first and
    size (the partitions below that node), hash, path, run (the nodes that
    become one parent, itself included: j, first, size; empty if the tree ends
    here), and other columns, which stay with the partition."""
    own = F.struct(*[c for c in state.columns if c not in ("part", "j", "hash")])
    mine = F.col("m.j") == F.col("j")
    offset = F.col("part") - F.col("first")
    meets = F.when(mine, 1).when(offset < F.col("m.size"), F.ceil((F.col("m.size") - offset) / F.col("size")))
    sent = (state.withColumn("own", own)
            .withColumn("m", F.explode(F.when(F.size("run") > 0, F.col("run")).otherwise(
                F.array(F.struct("j", "first", "size")))))
            .withColumn("meets", meets.cast("long")).where("meets > 0")
            .select("j", "hash", F.when(mine, F.col("own")).alias("own"), "meets", "size",
                    F.when(mine, F.col("part")).otherwise(F.col("m.first") + offset).alias("to"),
                    F.explode(F.sequence(F.lit(0), F.col("meets") - 1, F.lit(TARGETS).cast("long"))).alias("k"))
            .select("j", "hash", "own", "to", "size", F.explode(F.sequence(
                F.col("k"), F.least(F.col("k") + TARGETS, F.col("meets")) - 1)).alias("k"))
            .select((F.col("to") + F.col("k") * F.col("size")).alias("part"), "j", "hash", "own"))
    # at most one message from each node of the run
    got = sent.groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("j", "hash"))).alias("got"),
        F.first("own", ignorenulls=True).alias("own"),
        F.max(F.when(F.col("own").isNotNull(), F.col("j"))).alias("j"))
    at = F.size(F.filter("got", lambda x: x["j"] < F.col("j")))
    level = F.struct(at.alias("at"), F.transform(F.filter("got", lambda x: x["j"] != F.col("j")),
                                                 lambda x: x["hash"]).alias("others"))
    goes_on = F.size("own.run") > 0
    return got.select(
        "part", *[f"own.{c}" for c in state.columns if c not in ("part", "j", "hash", "path", "run", "first", "size")],
        F.when(goes_on, F.sha2(F.array_join(F.transform("got", lambda x: x["hash"]), ""), 256))
        .otherwise(F.get("got", F.lit(0))["hash"]).alias("hash"),
        F.when(goes_on, F.concat("own.path", F.array(level))).otherwise(F.col("own.path")).alias("path"))


def within_groups(state: DataFrame, fanout: int, r: int) -> DataFrame:
    """The geometry of round ``r`` below the subroots. ``state``: part, start
    (the group's first partition) and parts (their number), hash, path."""
    width = fanout ** r
    nodes = F.ceil(F.col("parts") / width)
    j = F.floor((F.col("part") - F.col("start")) / width)
    low = j - j % fanout
    run = F.transform(F.sequence(low, F.least(low + fanout, nodes) - 1), lambda i: F.struct(
        i.alias("j"), (F.col("start") + i * width).alias("first"),
        F.least(F.lit(width).cast("long"), F.col("parts") - i * width).alias("size")))
    empty = F.array().cast("array<struct<j:bigint,first:bigint,size:bigint>>")
    return state.select("*", j.alias("j"), (F.col("start") + j * width).alias("first"),
                        F.least(F.lit(width).cast("long"), F.col("parts") - j * width).alias("size"),
                        F.when(nodes > 1, run).otherwise(empty).alias("run"))


def across_groups(state: DataFrame, groups: DataFrame, fanout: int, r: int) -> DataFrame:
    """The geometry of round ``r`` above the subroots. ``groups``: g (place),
    start, parts of each group."""
    nodes = (groups.groupBy(F.floor(F.col("g") / fanout ** r).alias("j"))
             .agg(F.min("start").alias("first"), F.sum("parts").alias("size")))
    runs = (nodes.groupBy(F.floor(F.col("j") / fanout).alias("above"))
            .agg(F.array_sort(F.collect_list(F.struct("j", "first", "size"))).alias("run")))
    placed = (state.withColumn("j", F.floor(F.col("g") / fanout ** r))
              .withColumn("above", F.floor(F.col("j") / fanout)))
    me = F.get(F.filter("run", lambda x: x["j"] == F.col("j")), F.lit(0))
    return placed.join(broadcast_if_small(runs), "above").select(
        *state.columns, "j", me["first"].alias("first"), me["size"].alias("size"), "run")


def rounds(nodes: int, fanout: int) -> int:
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // fanout), n + 1
    return n


# --- the manifest -----------------------------------------------------------------

def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group: str = "lang",
             fanout: int = FANOUT, partition_leaves: int = PARTITION_LEAVES,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs``: ``id_col``, ``leaf``, ``subroot``, ``root``,
    ``proof`` (per level, leaf to root: the node's place in its run and the
    digests of the run's others) and the ``carry`` expressions over ``docs``."""
    carry = carry or {}
    height = 0
    while fanout ** (height + 1) <= partition_leaves:
        height += 1
    width = fanout ** height
    kept = ["_id", "leaf", *[f"_c{i}" for i in range(len(carry))]]
    leaves = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{group}`").cast("string").alias("_group"),
                         leaf(*[F.col(f"`{c}`") for c in columns]).alias("leaf"),
                         *[c.alias(f"_c{i}") for i, c in enumerate(carry.values())])
    # hashed once: dealing by range reads its rows twice
    leaves = numbered(written(leaves, "leaves"), ["_group", *kept], "leaves-in-order")
    sizes = leaves.groupBy("_group").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("leaves"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("leaves") / width))
    groups = written(numbered(sizes, ["first"], "groups", "parts")
                     .withColumnsRenamed({"n": "g", "before": "start", "_group": "_g"}), "groups")
    pos = F.col("n") - F.col("first")
    placed = (leaves.join(broadcast_if_small(groups), F.col("_group").eqNullSafe(F.col("_g")))
              .select(*kept, (F.col("start") + F.floor(pos / width)).alias("part"),
                      (pos % width).cast("int").alias("at"), "g", "start", "parts"))
    placed = written(placed, "leaves-placed")

    def ordered(rows: pa.Table) -> pa.Table:
        return rows.sort_by("at")

    def top(rows: pa.Table) -> pa.Table:
        rows = ordered(rows)
        one = rows.slice(0, 1)
        nodes = levels_of(rows["leaf"].to_pylist(), one["parts"][0].as_py() == 1, fanout, height)[-1]
        return pa.table({"part": one["part"], "g": one["g"], "start": one["start"], "parts": one["parts"],
                         "hash": pa.array(nodes, pa.string())})

    state = (placed.select("part", "at", "leaf", "g", "start", "parts").groupBy("part")
             .applyInArrow(top, "part long, g long, start long, parts long, hash string"))
    state = written(state.withColumn("path", F.array().cast(PROOF)), "exchange")
    most, n_groups = groups.agg(F.max("parts"), F.count(F.lit(1))).first()
    inner, outer = rounds(most or 0, fanout), rounds(n_groups, fanout)
    for r in range(inner + outer):
        if r and (r % ROUNDS_A_TABLE == 0):
            state = written(state, "exchange")
        if r == inner:
            state = state.withColumn("subroot", F.col("hash"))
        state = swap(within_groups(state, fanout, r) if r < inner else
                     across_groups(state, groups, fanout, r - inner))
    if not outer:
        state = state.withColumn("subroot", F.col("hash"))
    state = written(state.select("part", "subroot", F.col("hash").alias("root"), "path"), "exchange")

    level = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))

    def prove(rows: pa.Table, tops: pa.Table) -> pa.Table:
        rows = ordered(rows)
        whole = rows["parts"][0].as_py() == 1
        levels = levels_of(rows["leaf"].to_pylist(), whole, fanout, height)
        above = tops["path"][0].as_py()
        proofs = [own_proof(levels, i, fanout) + above for i in range(rows.num_rows)]
        same = {c: pa.repeat(tops[c][0], rows.num_rows) for c in ("subroot", "root")}
        return pa.table({**{c: rows[c] for c in kept}, **same, "proof": pa.array(proofs, level)})

    schema = ", ".join(f"{c} {dict(placed.dtypes)[c]}" for c in kept)
    proven = (placed.groupBy("part").cogroup(state.groupBy("part"))
              .applyInArrow(prove, f"{schema}, subroot string, root string, proof {PROOF}"))
    return proven.select(F.col("_id").alias(id_col), "leaf", "subroot", "root", "proof",
                         *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
