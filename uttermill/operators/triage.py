"""Classifier-based triage (TRI-1..4).

TRI-1 trains on the base corpus of every split and scores that split's
candidates, all splits in one job. Two model kinds:

- multinomial naive Bayes over lower-cased alphanumeric tokens, add-one
  smoothing, tokens outside the split's vocabulary ignored;
- nearest centroid over vectors, confidence = softmax(scale x cosine).

Naive Bayes scores candidates in Arrow batches: the weights of all splits are
one broadcast matrix (token x split and class), and a batch's distinct texts are
tokenised once for all splits, so no rows of tokens exist and nothing is
shuffled. A model too large for that is joined with the candidates' tokens,
with one aggregation per candidate. The centroid model
is one small row per split (classes x dimension), joined to the candidates
and applied in-row with higher-order functions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import tokens_lower
from ..session import broadcast_if_small, collect_if_small, materialize

#: Cells of a weight matrix, at most, and tokens summed at once.
MATRIX, TOKENS = 1 << 23, 1 << 15


def _k(keys) -> list[str]:
    return list(keys or ())


def _argmax_softmax(scores_col: str, scale: float = 1.0):
    """(pred, conf) from an array<struct<s: double, intent: string>>: the
    best class (ties -> smallest class name) and its softmax probability.

    One pass over the array with a running maximum (online log-sum-exp),
    so the result stays linear in the number of classes even where the
    optimizer inlines the score array into several expressions."""
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(None).cast("string").alias("p"),
                    F.lit(0.0).alias("z"))

    def step(acc, x):
        higher = F.struct(x["s"].alias("m"), x["intent"].alias("p"),
                          (acc["z"] * F.exp((acc["m"] - x["s"]) * scale) + 1.0).alias("z"))
        tie = F.struct(acc["m"].alias("m"), F.least(acc["p"], x["intent"]).alias("p"),
                       (acc["z"] + 1.0).alias("z"))
        lower = F.struct(acc["m"].alias("m"), acc["p"].alias("p"),
                         (acc["z"] + F.exp((x["s"] - acc["m"]) * scale)).alias("z"))
        return F.when(x["s"] > acc["m"], higher).when(x["s"] == acc["m"], tie).otherwise(lower)

    r = F.aggregate(scores_col, init, step)
    return r["p"], F.lit(1.0) / r["z"]


# --- naive Bayes -------------------------------------------------------------

def train_nb(base: DataFrame, keys=(), text: str = "text") -> dict:
    """TRI-1 (train): model tables of a multinomial naive Bayes per split.

    Returns ``classes`` (keys, intent, logprior, dlog = log(N_c + |V|)) and
    ``weights`` (keys, token, intent, w = log(n_ct + 1)).
    """
    k = _k(keys)
    toks = base.select(*k, "intent", F.explode(tokens_lower(F.col(text))).alias("token"))
    counts = toks.groupBy(*k, "intent", "token").agg(F.count(F.lit(1)).alias("n"))
    vocab = counts.groupBy(*k).agg(F.countDistinct("token").alias("_v"))
    ntok = counts.groupBy(*k, "intent").agg(F.sum("n").alias("_nc"))
    docs = base.groupBy(*k, "intent").agg(F.count(F.lit(1)).alias("_d"))
    total = docs.groupBy(*k).agg(F.sum("_d").alias("_dt"))
    classes = _join_keys(docs, total, k)
    classes = (_join_keys(classes.join(ntok, k + ["intent"], "left"), vocab, k)
               .select(*k, "intent",
                       F.log(F.col("_d") / F.col("_dt")).alias("logprior"),
                       F.log(F.coalesce("_nc", F.lit(0)) + F.coalesce("_v", F.lit(0))).alias("dlog")))
    weights = counts.select(*k, "token", "intent", F.log(F.col("n") + 1.0).alias("w"))
    return {"classes": classes, "weights": weights, "keys": k}


def _join_keys(a: DataFrame, b: DataFrame, k: list[str]) -> DataFrame:
    """Join on the run keys; without keys ``b`` is one row (a global
    total) and is attached as a scalar."""
    if k:
        return a.join(b, k, "left")
    row_cols = [c for c in b.columns]
    return a.select("*", *[b.select(F.first(c)).scalar().alias(c) for c in row_cols])


class _Scores:
    """The weights of every split: a row per token; per split the columns of
    its classes (in the order of ties) and one that counts its tokens."""

    def __init__(self, classes: list, weights: list):
        """Rows (*keys, intent, logprior, dlog) and (*keys, token, intent, w)."""
        splits: dict = {}
        for *key, intent, prior, dlog in classes:
            splits.setdefault(tuple(key), []).append((intent is None, intent or "", intent, prior, dlog))
        self.splits, column, width = {}, {}, 0
        for key, own in splits.items():
            own.sort()
            column.update({(key, x[2]): width + i for i, x in enumerate(own)})
            column[key] = width + len(own)
            self.splits[key] = (width, [x[2] for x in own], np.array([x[3] for x in own]), np.array([x[4] for x in own]))
            width += len(own) + 1
        self.rows = {t: i for i, t in enumerate(sorted({w[-3] for w in weights}))}
        self.matrix = np.zeros((len(self.rows), width))
        for *key, token, intent, w in weights:
            at = self.rows[token]
            self.matrix[at, column[tuple(key), intent]] = w
            self.matrix[at, column[tuple(key)]] = 1

    def sums(self, texts: list) -> np.ndarray:
        """Per text the sum of its tokens' rows."""
        out = np.zeros((len(texts), self.matrix.shape[1]))
        token = re.compile("[a-z0-9]+")
        known, of, first = [], [], 0
        for i, text in enumerate(texts):
            mine = [self.rows[t] for t in token.findall((text or "").lower()) if t in self.rows]
            if mine:
                of.append((i, len(known)))
                known.extend(mine)
            if known and (len(known) >= TOKENS or i + 1 == len(texts)):
                out[[x for x, _ in of]] = np.add.reduceat(self.matrix[known], [at for _, at in of], axis=0)
                known, of = [], []
        return out

    def score(self, keys: list[tuple], texts: list, which: np.ndarray) -> tuple[list, list]:
        """(pred, conf) of rows: their run keys, and their texts by index."""
        sums = self.sums(texts)
        pred, conf = [None] * len(keys), [None] * len(keys)
        rows: dict = {}
        for i, key in enumerate(keys):
            rows.setdefault(key, []).append(i)
        for key, mine in rows.items():
            if key not in self.splits:
                continue
            at, names, prior, dlog = self.splits[key]
            own = sums[which[mine]]
            s = prior - own[:, at + len(names), None] * dlog + own[:, at:at + len(names)]
            best = s.argmax(axis=1)
            share = 1 / np.exp(s - s.max(axis=1)[:, None]).sum(axis=1)
            for i, j, c in zip(mine, best.tolist(), share.tolist()):
                pred[i], conf[i] = names[j], c
        return pred, conf


def score_nb(model: dict, candidates: DataFrame, ids, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """TRI-1 (score): ``pred`` and ``conf`` for every candidate of a split, with
    the candidates' columns (those in ``keep``, if given).

    ``candidates`` carry the run keys and unique ``ids`` within a split. A
    candidate without known tokens scores its priors."""
    k, keep = model["keys"], list(keep or candidates.columns)
    classes, weights = materialize(model["classes"]), materialize(model["weights"])
    held = collect_if_small(classes.select(*k, "intent", "logprior", "dlog"))
    table = None if held is None else collect_if_small(weights.select(*k, "token", "intent", "w"))
    if table is None or len({w[-3] for w in table}) * (2 * len(held) + 1) > MATRIX:
        return _score_nb_joined({**model, "classes": classes, "weights": weights}, candidates, ids, text).select(
            *keep, "pred", "conf")
    shared = candidates.sparkSession.sparkContext.broadcast(_Scores(held, table))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            whole = pc.dictionary_encode(b.column(text), null_encoding="encode")
            keys = list(zip(*[b.column(c).to_pylist() for c in k])) if k else [()] * b.num_rows
            pred, conf = shared.value.score(keys, whole.dictionary.to_pylist(), whole.indices.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(pred, pa.string()),
                                              pa.array(conf, pa.float64())], [*keep, "pred", "conf"])

    fields = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    return candidates.mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", pred string, conf double")


def _score_nb_joined(model: dict, candidates: DataFrame, ids, text: str) -> DataFrame:
    """The candidate tokens meet the model's weight table in a join, the weights
    of one candidate are summed per class in one aggregation, and the scores are
    joined back to the candidates."""
    k = model["keys"]
    ids = list(ids)
    classes, weights = model["classes"], model["weights"]
    # vocabulary marker rows (class null, w 0) count the in-vocabulary tokens
    vocab = weights.select(*k, "token").distinct().select(
        *k, "token", F.lit(None).cast("string").alias("_c"), F.lit(0.0).alias("w"))
    table = broadcast_if_small(weights.select(*k, "token", F.col("intent").alias("_c"), "w").unionByName(vocab))
    toks = candidates.select(*k, *ids, F.explode(tokens_lower(F.col(text))).alias("token"))
    per = (toks.join(table, k + ["token"])
           .groupBy(*k, *ids, "_c")
           .agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n"))
           .groupBy(*k, *ids)
           .agg(F.collect_list(F.struct(F.col("_c").alias("intent"), "s", "n")).alias("_parts")))
    cls = broadcast_if_small(classes.groupBy(*k).agg(
        F.collect_list(F.struct("intent", "logprior", "dlog")).alias("_cls")))
    c = _join_keys(candidates.join(per, k + ids, "left"), cls, k)
    n_in = F.coalesce(F.aggregate(F.filter("_parts", lambda p: p["intent"].isNull()), F.lit(0).cast("long"),
                                  lambda acc, p: acc + p["n"]), F.lit(0).cast("long"))
    scores = F.transform("_cls", lambda cl: F.struct(
        (cl["logprior"] - n_in * cl["dlog"]
         + F.coalesce(F.aggregate(F.filter("_parts", lambda p: p["intent"] == cl["intent"]),
                                  F.lit(0.0), lambda acc, p: acc + p["s"]), F.lit(0.0))).alias("s"),
        cl["intent"].alias("intent")))
    c = c.withColumn("_s", scores)
    pred, conf = _argmax_softmax("_s")
    return c.withColumn("pred", pred).withColumn("conf", conf).drop("_parts", "_cls", "_s")


# --- nearest centroid ---------------------------------------------------------

def centroid_model(base: DataFrame, keys=(), vec: str = "vec") -> DataFrame:
    """TRI-1 (train), vector kind: per (keys, intent) the mean vector."""
    k = _k(keys)
    parts = base.select(*k, "intent", F.posexplode(vec).alias("i", "x"))
    means = parts.groupBy(*k, "intent", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (means.groupBy(*k, "intent")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid")))


def score_centroid(model: DataFrame, candidates: DataFrame, keys=(), vec: str = "vec",
                   scale: float = 20.0) -> DataFrame:
    """TRI-1 (score), vector kind: predicted class = highest cosine to a
    centroid of the split (ties -> smallest class name); confidence =
    softmax over classes of ``scale`` x cosine."""
    from ..functions import cosine
    k = _k(keys)
    m = broadcast_if_small(model.groupBy(*k).agg(F.collect_list(F.struct("intent", "centroid")).alias("_cen")))
    c = _join_keys(candidates, m, k)
    c = c.withColumn("_s", F.transform("_cen", lambda e: F.struct(
        cosine(F.col(vec), e["centroid"]).alias("s"), e["intent"].alias("intent"))))
    pred, conf = _argmax_softmax("_s", scale)
    return c.withColumn("pred", pred).withColumn("conf", conf).drop("_cen", "_s")


# --- TRI-2..4 -------------------------------------------------------------------

def uncertain(predictions: DataFrame, threshold: float = config.THRESHOLD) -> DataFrame:
    """TRI-2: keep misclassified candidates and correct ones with
    confidence strictly below the threshold; ``is_error`` orders errors
    first. Intents without survivors simply have no rows."""
    err = F.col("pred") != F.col("intent")
    return predictions.where(err | (F.col("conf") < threshold)).withColumn("is_error", err)


def triage_table(scored: DataFrame, threshold: float = config.THRESHOLD,
                 origin: str = "origin_text", text: str = "text") -> DataFrame:
    """TRI-3: every candidate whose text differs from its origin, with the
    category 'error', 'low cs' or 'success' (the distance column is carried
    by the caller, DST-4)."""
    cat = (F.when(F.col("pred") != F.col("intent"), "error")
           .when(F.col("conf") < threshold, "low cs").otherwise("success"))
    return scored.where(F.col(text) != F.col(origin)).withColumn("category", cat)


def best_per_origin(triage: DataFrame, originals: DataFrame, keys=(), origin: str = "origin_pos",
                    dist: str = "dist", first_low_conf: bool = False) -> DataFrame:
    """TRI-4: one candidate per original: among its errors the largest
    distance, else among low-confidence ones the largest distance (or the
    first one, ``first_low_conf``); ties by position, then text. Result: the originals
    plus the picks (bag union, column ``picked`` marks the picks)."""
    k = _k(keys)
    cand = triage.where(F.col("category").isin("error", "low cs"))
    is_err = (F.col("category") == "error")
    d = F.when(is_err | F.lit(not first_low_conf), F.col(dist)).otherwise(F.lit(0))
    cols = list(dict.fromkeys(k + ["intent", "text", "pos"]))
    order = [(~is_err).alias("_o0"), d.isNull().alias("_o1"), (-d).alias("_o2"), F.col("pos").isNotNull().alias("_o3")]
    cand = cand.select(*dict.fromkeys([*cols, origin]), *order)
    group, by = [*k, origin], ["_o0", "_o1", "_o2", "_o3", "pos", "text"]
    w = Window.partitionBy(*group).orderBy(*by)
    picks = _first_of_batches(cand, group, by).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return (originals.select(*cols, F.lit(False).alias("picked"))
            .unionByName(picks.select(*cols, F.lit(True).alias("picked"))))


def _first_of_batches(df: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """Of every Arrow batch the first row of each group in the order ``by``: a
    group limit that sorts no more than a batch at once."""
    def run(batches):
        for b in batches:
            seen, first = set(), []
            order = pc.sort_indices(b, sort_keys=[(c, "ascending") for c in by]).to_pylist()
            keys = list(zip(*[b.column(c).to_pylist() for c in group]))
            for i in order:
                if keys[i] not in seen:
                    seen.add(keys[i])
                    first.append(i)
            yield b.take(pa.array(first, pa.int64()))

    return df.mapInArrow(run, df.schema)
