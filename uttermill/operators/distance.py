"""Edit distance and similarity (DST-2..5).

Originals are the small side (few-shot sets): within a checked size they are a
broadcast variable, and the candidates stream past them in Arrow batches. A
batch is measured by the bit-parallel kernel of ``functions.edit`` (5 times as
fast as ``levenshtein`` on whole lines), which visits originals from the
candidate's own length outwards and keeps one running best a candidate. The
candidates are never shuffled on a key and no candidate x original rows exist.

Beyond that size, a q-gram index first finds all originals within a share of
the candidate's length (``near_originals``); candidates without one meet
bounded blocks of the originals.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import words_ws
from ..functions.edit import Originals, Prefixes
from ..session import broadcast_if_small, collect_if_small, materialize, spread

#: q-gram index: gram length, and the share of a candidate's length up to which it finds originals.
GRAM, NEAR_SHARE = 4, 0.1
#: Most texts that a block holds of either side.
BLOCK = 4096


def _k(keys) -> list[str]:
    return list(keys or ())


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + more


def _nearest_rows(batch: pa.Table, groups: dict, keys: list[str], text: str):
    """(distance, position, text) lists of the nearest originals of a batch's rows."""
    rows: dict = {}
    for i, (key, t) in enumerate(zip(zip(*[batch.column(c).to_pylist() for c in keys]), batch.column(text).to_pylist())):
        if t is not None and key in groups:
            rows.setdefault(key, []).append((i, t))
    dist, pos, near = ([None] * batch.num_rows for _ in range(3))
    for key, own in rows.items():
        d, at = groups[key].nearest([t for _, t in own])
        for (i, _), x, j in zip(own, d.tolist(), at.tolist()):
            dist[i], pos[i], near[i] = x, groups[key].pos[j], groups[key].texts[j]
    return pa.array(dist, pa.int32()), pa.array(pos, pa.int64()), pa.array(near, pa.string())


def min_distance(candidates: DataFrame, originals: DataFrame, keys=(), cand_col: str = "text",
                 orig_col: str = "text", out: str = "dist", with_nearest: bool = False,
                 max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """DST-2: minimum unit-cost edit distance from each candidate to the
    originals of the same run keys and intent. No originals, or a null text
    -> null.

    With ``with_nearest`` also the nearest original (``origin_text``,
    ``origin_pos``; ties -> smallest original position, then text).
    Originals of more than ``max_rows`` rows, or too many bytes, are not
    broadcast but indexed."""
    k = _k(keys) + ["intent"]
    pos = F.col("pos") if "pos" in originals.columns else F.lit(None)
    o = originals.select(*k, F.col(orig_col).alias("_t"), pos.cast("long").alias("_p")).where(
        " AND ".join(f"{c} IS NOT NULL" for c in [*k, "_t"]))
    rows = collect_if_small(o, max_rows)
    if rows is None:
        return _min_distance_indexed(candidates, o, k, cand_col, out, with_nearest)
    groups: dict = {}
    for *key, t, p in rows:
        groups.setdefault(tuple(key), []).append((t, p))
    shared = candidates.sparkSession.sparkContext.broadcast(
        {key: Originals(*map(list, zip(*ts))) for key, ts in groups.items()})

    def run(batches):
        for b in batches:
            d, p, t = _nearest_rows(b, shared.value, k, cand_col)
            more = [d, p, t] if with_nearest else [d]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, out, "origin_pos", "origin_text"]
                                             [:len(b.schema.names) + len(more)])

    extra = f", {out} int" + (", origin_pos long, origin_text string" if with_nearest else "")
    res = spread(candidates).mapInArrow(run, _schema(candidates, extra))
    return res.select(*candidates.columns, out, *(["origin_text", "origin_pos"] if with_nearest else []))


# --- many originals ---------------------------------------------------------------

def _grams(text, q: int):
    """Distinct hashes of the text's q-grams (the whole text if shorter)."""
    n = F.greatest(F.length(text) - q + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.substr(text, i, F.lit(q)))))


def near_originals(candidates: DataFrame, originals: DataFrame, k: list[str], text: str = "_t",
                   q: int = GRAM, share: float = NEAR_SHARE) -> DataFrame:
    """(_rid, _d, _p, _o): for every candidate with an original within r =
    ``share`` of its length, the nearest one. Exact for those candidates.

    r edits change at most q r of a text's q-grams, so of each side's grams in
    the order of their rarity the first q r + 1 have one in common: these
    prefixes are joined, lengths may differ by r, at least all but q r grams of
    the larger side must be shared (count filter), and what is left is verified
    by ``levenshtein`` with the bound r."""
    c = candidates.select("_rid", *k, F.col(text).alias("_c"), _grams(F.col(text), q).alias("_g"))
    # an original may be r longer than the candidate, so its own radius is a share of the shorter length
    radius = F.floor(F.length("_c") * share).cast("int")
    wide = F.floor(F.length("_o") * share / (1 - share)).cast("int")
    o = materialize(originals.select(*k, F.col("_t").alias("_o"), "_p", F.monotonically_increasing_id().alias("_oid"))
                    .withColumn("_g", _grams(F.col("_o"), q)))
    often = o.select(F.explode("_g").alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))

    def prefix(df: DataFrame, key: str, r) -> DataFrame:
        grams = (df.select(*k, key, (q * r + 1).alias("_most"), F.explode("_g").alias("_x"))
                 .join(broadcast_if_small(often), "_x", "left"))  # a gram of no original is the rarest
        w = Window.partitionBy(key).orderBy(F.coalesce("_n", F.lit(0)), "_x")
        return (grams.withColumn("_r", F.row_number().over(w))
                .where((F.col("_r") <= F.col("_most")) & F.col("_n").isNotNull()).select(*k, key, "_x"))

    met = prefix(c, "_rid", radius).join(prefix(o, "_oid", wide), [*k, "_x"]).select("_rid", "_oid").distinct()
    both = met.join(c.select("_rid", "_c", "_g"), "_rid").join(
        o.select("_oid", "_o", "_p", F.col("_g").alias("_h")), "_oid")
    most = F.greatest(F.size("_g"), F.size("_h"))
    both = both.where((F.abs(F.length("_c") - F.length("_o")) <= radius)
                      & (F.size(F.array_intersect("_g", "_h")) >= most - q * radius))
    both = both.withColumn("_d", F.call_function("levenshtein", F.col("_c"), F.col("_o"), radius)).where("_d >= 0")
    return both.groupBy("_rid").agg(F.min(F.struct("_d", "_p", "_o")).alias("_b")).select("_rid", "_b.*")


def _min_distance_indexed(candidates: DataFrame, originals: DataFrame, k: list[str], cand_col: str, out: str,
                          with_nearest: bool) -> DataFrame:
    c = materialize(candidates.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_t", F.col(cand_col)))
    asked = c.where(" AND ".join(f"{x} IS NOT NULL" for x in [*k, "_t"])).select("_rid", *k, "_t")
    near = materialize(near_originals(asked, originals, k))
    far = asked.join(near.select("_rid"), "_rid", "left_anti")
    # the others meet blocks of the originals: both sides of a block are bounded
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    parts = originals.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).select(*k, blocks.alias("_no")).join(
        far.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).select(*k, blocks.alias("_nc")), k)
    parts = broadcast_if_small(parts)

    def dealt(df: DataFrame, key, own: str, other: str) -> DataFrame:
        mine, theirs = ("_bo", "_bc") if own == "_no" else ("_bc", "_bo")
        return (df.join(parts, k).withColumn(mine, F.pmod(F.xxhash64(*key), F.col(own)).cast("int"))
                .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_no", "_nc"))

    by = [*k, "_bo", "_bc"]

    def measure(cands, origs):
        group = Originals(origs["_t"].to_pylist(), origs["_p"].to_pylist()) if origs.num_rows else None
        if group is None or not cands.num_rows:
            return pa.table({"_rid": pa.array([], pa.int64()), "_d": pa.array([], pa.int32()),
                             "_p": pa.array([], pa.int64()), "_o": pa.array([], pa.string())})
        d, at = group.nearest(cands["_t"].to_pylist())
        return pa.table({"_rid": cands["_rid"], "_d": pa.array(d, pa.int32()),
                         "_p": pa.array([group.pos[j] for j in at.tolist()], pa.int64()),
                         "_o": pa.array([group.texts[j] for j in at.tolist()], pa.string())})

    found = (dealt(far, ["_rid"], "_nc", "_no").groupBy(*by)
             .cogroup(dealt(originals, ["_t", "_p"], "_no", "_nc").groupBy(*by))
             .applyInArrow(measure, "_rid long, _d int, _p long, _o string"))
    best = found.unionByName(near).groupBy("_rid").agg(F.min(F.struct("_d", "_p", "_o")).alias("_b"))
    res = c.join(best, "_rid", "left")
    more = [F.col("_b._o").alias("origin_text"), F.col("_b._p").alias("origin_pos")] if with_nearest else []
    return res.select(*candidates.columns, F.col("_b._d").alias(out), *more)


# --- nested few-shot splits ---------------------------------------------------------

def min_distance_fewshot(candidates: DataFrame, picks: DataFrame, sizes, cand_col: str = "text",
                         orig_col: str = "text", out: str = "dist", with_nearest: bool = False) -> DataFrame:
    """DST-2 specialised to nested few-shot splits (SET-5): the originals
    of split (n, run) are the picks of ``run`` with rank <= n. Distances to
    the largest split are computed once per (candidate, run); every split
    takes the minimum over its prefix. Candidates that are originals of a
    split are left out of that split (SET-2).

    ``candidates``: intent, text, pos (+ ``cand_col``); ``picks``: run,
    intent, rk, pos and ``orig_col`` (only the largest split's rows are
    used). Output: train_n, run, candidate columns, ``out`` (and
    ``origin_pos`` / ``origin_text`` of the nearest original, ties ->
    smallest position, with ``with_nearest``). A candidate whose intent has
    no picks gets one row a size with null run and distance."""
    top = max(sizes)
    p = picks.where(F.col("train_n") == top) if "train_n" in picks.columns else picks
    p = p.select("run", "intent", "rk", F.col(orig_col).alias("_t"), F.col("pos").alias("_p"), F.col("text").alias("_o"))
    rows = collect_if_small(p)
    if rows is None:  # as many few-shot picks as candidates: every split is an original set of its own
        splits = p.withColumn("train_n", F.explode(F.array(*[F.lit(int(n)) for n in sizes]))).where("rk <= train_n")
        keys = ["train_n", "run"]
        grid = splits.select(*keys, "intent").distinct()
        own = splits.select(*keys, "intent", F.col("_o").alias("text"))
        each = candidates.join(grid, "intent", "left").join(own, [*keys, "intent", "text"], "left_anti")
        return min_distance(each, splits.select(*keys, "intent", "_t", F.col("_p").alias("pos")), keys, cand_col, "_t",
                            out, with_nearest).select(*keys, *candidates.columns, out,
                                                      *(["origin_pos", "origin_text"] if with_nearest else []))
    groups: dict = {}
    for run, intent, rk, t, pos, o in rows:
        groups.setdefault(intent, []).append((run, rk, t, pos, o))
    shared = candidates.sparkSession.sparkContext.broadcast({i: Prefixes(r) for i, r in groups.items()})
    sizes = [int(n) for n in sizes]

    def measure(batches):
        for b in batches:
            intents, texts, names = (b.column(c).to_pylist() for c in ("intent", cand_col, "text"))
            row, train_n, of_run, dist, pos, near = ([] for _ in range(6))
            members: dict = {}
            for i, (intent, t) in enumerate(zip(intents, texts)):
                if intent in shared.value:
                    members.setdefault(intent, []).append(i)
                else:
                    for n in sizes:
                        for col, v in zip((row, train_n, of_run, dist), (i, n, None, None)):
                            col.append(v)
                        if with_nearest:
                            pos.append(None)
                            near.append(None)
            for intent, mine in members.items():
                group = shared.value[intent]
                known = [i for i in mine if texts[i] is not None]
                at = {i: j for j, i in enumerate(known)}
                found = group.nearest([texts[i] for i in known], sizes)
                for run in group.runs:
                    of = group.of[run]
                    first = {}
                    for rk, _, _, o in of:
                        first.setdefault(o, rk)
                    for n in sizes:
                        d, which = (x.tolist() for x in found[run, n])
                        for i in mine:
                            if first.get(names[i], n + 1) <= n:
                                continue
                            row.append(i)
                            train_n.append(n)
                            of_run.append(run)
                            j = at.get(i)
                            dist.append(None if j is None else d[j])
                            if with_nearest:
                                pos.append(None if j is None else of[which[j]][2])
                                near.append(None if j is None else of[which[j]][3])
            whole = b.take(pa.array(row, pa.int64()))
            more = [pa.array(dist, pa.int32())]
            if with_nearest:
                more += [pa.array(pos, pa.int64()), pa.array(near, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(train_n, pa.int32()), pa.array(of_run, run_type), *whole.columns, *more],
                ["train_n", "run", *b.schema.names, out, "origin_pos", "origin_text"][:2 + whole.num_columns + len(more)])

    kind = dict(p.dtypes)["run"]
    run_type = {"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.string())
    extra = f", {out} int" + (", origin_pos long, origin_text string" if with_nearest else "")
    return spread(candidates).mapInArrow(measure, f"train_n int, run {kind}, " + _schema(candidates, extra))


def farthest_per_intent(df: DataFrame, k: int = config.KEEP_BY_DISTANCE, keys=(),
                        dist: str = "dist", tie: str = "pos", first: str | None = None) -> DataFrame:
    """DST-3: per (keys, intent) the k rows with the largest distance;
    ties keep input order (rows with ``first`` true, if given, then ``tie``,
    then the text); null distances rank
    last. A top-k window, so Spark applies the group limit before the
    shuffle."""
    kk = _k(keys)
    order = [F.col(dist).desc_nulls_last(), *([F.col(first).desc()] if first else []), F.col(tie).asc()] + ([F.col("text")] if "text" in df.columns else [])
    w = Window.partitionBy(*kk, "intent").orderBy(*order)
    return df.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def pair_distance(df: DataFrame, a: str, b: str, out: str = "dist") -> DataFrame:
    """DST-4: edit distance between two columns of the same row."""
    return df.withColumn(out, F.levenshtein(F.col(a), F.col(b)))


def jaccard(a, b):
    """Token-set Jaccard of two word arrays (distinct words)."""
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    inter = F.size(F.array_intersect(sa, sb))
    return inter / (F.size(sa) + F.size(sb) - inter)


def jaccard_pairs(candidates: DataFrame, originals: DataFrame, keys=(), min_sim: float = 0.25,
                  text: str = "text") -> DataFrame:
    """DST-5: (candidate, original) pairs of the same run keys and intent
    whose token-set Jaccard similarity (blank-separated, case-sensitive) is
    at least ``min_sim`` (above 0).

    A prefix-filter join. Tokens are numbered by their frequency among the
    originals, the rarest first; a set of n tokens has its partners only among
    those that share one of its first n - ceil(min_sim n) + 1 tokens. Prefixes
    are joined on the token; lengths and the positions of the common token
    bound the overlap from above; what can reach ``min_sim`` is verified on the
    whole sets. Equal texts of an intent are one set in all runs."""
    if min_sim <= 0:
        raise ValueError("min_sim must be above 0: pairs without a common token are not joined")
    k, t = _k(keys), min_sim - 1e-9

    def sets(df: DataFrame, name: str) -> DataFrame:
        one = df.select("intent", F.col(text).alias("_text")).distinct()
        return materialize(one.select("intent", "_text", F.monotonically_increasing_id().alias(name)))

    a, o = sets(candidates, "_a"), sets(originals, "_o")
    words = F.array_distinct(words_ws(F.col("_text")))
    often = o.select(F.explode(words).alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("_f"))
    # sorted, so the ids are the order: a token's number stands for it from here on
    number = broadcast_if_small(materialize(often.orderBy("_f", F.xxhash64("_x"), "_x").select(
        F.col("_x").alias("_word"), F.monotonically_increasing_id().alias("_x"))))

    def ordered(df: DataFrame, name: str) -> DataFrame:
        """Size and, in order, the numbers of the tokens that some original has."""
        split = df.select(name, "intent", words.alias("_w"))
        known = split.select(name, "intent", F.size("_w").alias("_n"), F.explode("_w").alias("_word")).join(number, "_word")
        return materialize(known.groupBy(name, "intent", "_n").agg(F.array_sort(F.collect_list("_x")).alias("_r")))

    def prefix(df: DataFrame, name: str, n: str, at: str) -> DataFrame:
        """Tokens of the prefix with their place; those that no original has stand in front."""
        unknown = F.col("_n") - F.size("_r")
        length = F.col("_n") - F.ceil(F.col("_n") * t).cast("int") + 1 - unknown
        return df.where(length > 0).select(name, "intent", F.col("_n").alias(n), unknown.alias("_u"),
                                           F.posexplode(F.slice("_r", F.lit(1), length))).select(
            name, "intent", n, (F.col("pos") + F.col("_u")).alias(at), F.col("col").alias("_x"))

    ra, ro = ordered(a, "_a"), ordered(o, "_o")
    met = prefix(ra, "_a", "_na", "_ia").join(broadcast_if_small(prefix(ro, "_o", "_no", "_io")), ["intent", "_x"])
    # the first common token counts; behind it at most the shorter rest is shared
    met = met.groupBy("_a", "_o", "_na", "_no").agg(F.min("_ia").alias("_ia"), F.min("_io").alias("_io"))
    most = F.least(F.col("_na") - F.col("_ia"), F.col("_no") - F.col("_io"))
    met = met.where((F.least("_na", "_no") >= t * F.greatest("_na", "_no"))
                    & (most >= t / (1 + t) * (F.col("_na") + F.col("_no"))))
    both = (met.join(ra.select("_a", F.col("_r").alias("_ra")), "_a")
            .join(broadcast_if_small(ro.select("_o", F.col("_r").alias("_ro"))), "_o"))
    inter = F.size(F.array_intersect("_ra", "_ro"))
    sims = (both.select("_a", "_o", (inter / (F.col("_na") + F.col("_no") - inter)).alias("sim"))
            .where(F.col("sim") >= F.lit(min_sim)))
    # back to the rows of every run
    named = sims.join(o.select("_o", "intent", F.col("_text").alias("_ot")), "_o")
    rows = named.join(broadcast_if_small(originals.select(
        *k, "intent", F.col(text).alias("_ot"), F.col("pos").cast("long").alias("orig_pos"))), ["intent", "_ot"])
    rows = a.select("_a", F.col("_text").alias(text)).join(broadcast_if_small(materialize(rows)), "_a")
    rows = broadcast_if_small(materialize(rows.select(*k, "intent", text, "orig_pos", "sim")))
    return candidates.join(rows, [*k, "intent", text]).select(*candidates.columns, "orig_pos", "sim")


def farthest_from_fewshot(candidates: DataFrame, picks: DataFrame, sizes, k: int = config.KEEP_BY_DISTANCE) -> DataFrame:
    """DST-2 + DST-3 for nested few-shot splits with exact length pruning.

    For each candidate and split, |len(c) - len(o)| <= lev(c, o) <=
    max(len(c), len(o)) bound its minimum distance from below (``lb``) and
    above (``ub``). Per (split, intent) let tau be the k-th largest ``lb``:
    at least k candidates are at distance >= tau, so a candidate with
    ``ub < tau`` can never be among the k farthest. Both bounds follow from
    the length, so tau comes from the counts of the candidates by length (the
    originals among them have ``lb`` 0 and cannot raise it). Only the remaining
    ones get exact distances; the result equals ``farthest_per_intent`` over
    ``min_distance_fewshot``.
    """
    top = max(sizes)
    p = materialize(picks.where(F.col("train_n") == top) if "train_n" in picks.columns else picks)
    arr = broadcast_if_small(p.groupBy("run", "intent").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("rk", F.length("text").alias("n")))), lambda x: x["n"]).alias("_ol")))
    each = F.explode(F.array(*[F.lit(int(n)) for n in sizes])).alias("train_n")
    known = candidates.where(F.col("text").isNotNull()).withColumn("_len", F.length("text"))
    c = known.groupBy("intent", "_len").agg(F.count(F.lit(1)).alias("_c")).join(arr, "intent")
    c = c.select("run", "intent", "_len", "_c", "_ol", each)
    first = F.slice("_ol", F.lit(1), F.col("train_n"))
    keys = ["train_n", "run", "intent"]
    c = materialize(c.select(*keys, "_len", "_c",
                             F.array_min(F.transform(first, lambda n: F.abs(F.col("_len") - n))).alias("_lb"),
                             F.array_min(F.transform(first, lambda n: F.greatest(F.col("_len"), n))).alias("_ub")))
    w = Window.partitionBy(*keys).orderBy(F.col("_lb").desc(), "_len").rowsBetween(Window.unboundedPreceding, 0)
    tau = (c.withColumn("_m", F.sum("_c").over(w)).groupBy(*keys)
           .agg(F.max(F.when(F.col("_m") >= k, F.col("_lb"))).alias("_tau")))
    need = (c.join(broadcast_if_small(tau), keys).where(F.col("_ub") >= F.coalesce("_tau", F.lit(-1)))
            .select(*keys, "_len"))
    splits = p.select("run", "intent", "rk", "text", "pos", each).where(F.col("rk") <= F.col("train_n"))
    survivors = known.join(broadcast_if_small(materialize(need)), ["intent", "_len"]).join(
        broadcast_if_small(splits.select(*keys, "text").distinct()), [*keys, "text"], "left_anti")
    # exact distances for the survivors only
    near = min_distance(survivors.select(*candidates.columns, "run", "train_n"), splits, keys)
    return farthest_per_intent(near.select("train_n", "run", *candidates.columns, "dist"), k, keys=keys)
