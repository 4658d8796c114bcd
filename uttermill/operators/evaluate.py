"""Evaluation analytics (EVA-1..10).

Predictions: run keys + ``text``, ``intent`` (true), ``pred``, ``conf``.
Reports: run keys + ``intent``, ``precision``, ``recall``, ``f1``,
``support``. Every aggregate is a hash aggregation with a map-side partial
step; no class or run ever gathers its rows in one task, and the confidence lists
of EVA-4/5 are kept as a long table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def _k(keys) -> list[str]:
    return list(keys or ())


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_report(predictions: DataFrame, keys=()) -> DataFrame:
    """EVA-1: per (keys, class) precision, recall, f1 and support over the
    distinct evaluated utterances. Classes = true or predicted ones;
    undefined ratios are 0.0."""
    k = _k(keys)
    p = predictions.dropDuplicates(k + ["text", "intent", "pred"])
    # each prediction counts once as a true label and once as a predicted label
    sides = F.explode(F.array(
        F.struct(F.col("intent").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 (F.col("intent") == F.col("pred")).cast("int").alias("tp")),
        F.struct(F.col("pred").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")),
    ))
    agg = (p.select(*k, sides.alias("s"))
           .groupBy(*k, F.col("s.c").alias("intent"))
           .agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.tp").alias("tp")))
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    return (agg.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                        F.col("precision") + F.col("recall")))
            .select(*k, "intent", "precision", "recall", "f1", F.col("support").cast("long").alias("support"),
                    F.col("tp").cast("long").alias("tp")))


def confused_with(predictions: DataFrame, n: int = 3, keys=(), as_map: bool = False) -> DataFrame:
    """EVA-2: per (keys, true class) the n most frequent wrong predicted
    classes (ties by class name). Rows, or one map per class."""
    k = _k(keys)
    p = predictions.dropDuplicates(k + ["text", "intent", "pred"]).where(F.col("pred") != F.col("intent"))
    c = p.groupBy(*k, "intent", F.col("pred").alias("confused")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*k, "intent").orderBy(F.col("n").desc(), F.col("confused"))
    top = c.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n)
    if not as_map:
        return top
    return (top.groupBy(*k, "intent")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("confused", "n")))).alias("confused_with")))


def report_totals(report: DataFrame, keys=()) -> DataFrame:
    """EVA-3: accuracy, macro (plain mean over classes) and weighted
    (support-weighted) precision / recall / f1, total support."""
    k = _k(keys)
    tot = F.sum("support")

    def wavg(c):
        return _safe_div(F.sum(F.col(c) * F.col("support")), tot)

    return report.groupBy(*k).agg(
        _safe_div(F.sum("tp"), tot).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        wavg("precision").alias("weighted_precision"), wavg("recall").alias("weighted_recall"),
        wavg("f1").alias("weighted_f1"), tot.cast("long").alias("support"))


def confidences(predictions: DataFrame, keys=("train_n", "run")) -> DataFrame:
    """EVA-4/5 lists, kept long: one row per evaluated utterance with
    ``outcome`` ('success' / 'error') and ``conf``. The reference's list
    cells are this table grouped by run (EVA-4) or by size (EVA-5); it is
    never gathered into one row, so a run of any size stays distributed."""
    k = _k(keys)
    ok = F.col("pred") == F.col("intent")
    return predictions.select(*k, F.when(ok, "success").otherwise("error").alias("outcome"), "conf")


def run_summary(totals: DataFrame, predictions: DataFrame, keys=("train_n", "run")) -> DataFrame:
    """EVA-4: per run the mean over evaluation loops of weighted precision,
    recall, f1 and support, with the number of success and error
    confidences (the values themselves: ``confidences``). A run without a
    prediction log has zero counts."""
    k = _k(keys)
    means = totals.groupBy(*k).agg(
        F.avg("weighted_precision").alias("precision"), F.avg("weighted_recall").alias("recall"),
        F.avg("weighted_f1").alias("f1_score"), F.avg("support").alias("support"))
    cs = (confidences(predictions, k).groupBy(*k)
          .agg(F.count_if(F.col("outcome") == "success").alias("n_successes"),
               F.count_if(F.col("outcome") == "error").alias("n_errors")))
    return (means.join(cs, k, "left")
            .withColumn("n_successes", F.coalesce("n_successes", F.lit(0)))
            .withColumn("n_errors", F.coalesce("n_errors", F.lit(0))))


def size_summary(runs: DataFrame, size: str = "train_n") -> DataFrame:
    """EVA-5: per training size the mean of the run means (not a pooled
    mean); list sizes add up."""
    return runs.groupBy(size).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1_score").alias("f1_score"), F.avg("support").alias("support"),
        F.sum("n_successes").alias("n_successes"), F.sum("n_errors").alias("n_errors"))


def run_listing(grid: DataFrame, totals: DataFrame, keys=("train_n", "run")) -> DataFrame:
    """EVA-6: one row per grid point with its weighted scores and macro f1;
    missing runs show as nulls (grid left join totals)."""
    k = _k(keys)
    t = totals.select(*k, F.col("weighted_precision").alias("precision"),
                      F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1_score"),
                      "support", "macro_f1")
    return grid.select(*k).distinct().join(t, k, "left")


def intent_summary(report: DataFrame, size: str = "train_n", run: str = "run") -> DataFrame:
    """EVA-7: per intent mean over loops, then mean over runs, of
    precision, recall and f1."""
    per_run = report.groupBy(size, run, "intent").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return per_run.groupBy(size, "intent").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def new_example_counts(kept: DataFrame, report: DataFrame, size: str = "train_n",
                       run: str = "run") -> DataFrame:
    """EVA-8: per (size, run, intent) the number of kept texts summed over
    loops, 0 for report intents without any; then averaged over runs.
    ``kept`` holds one row per kept text (an exploded filter result)."""
    counts = kept.groupBy(size, run, "intent").agg(F.count(F.lit(1)).alias("new_examples"))
    intents = report.select(size, run, "intent").distinct()
    per_run = (intents.join(counts, [size, run, "intent"], "left")
               .withColumn("new_examples", F.coalesce("new_examples", F.lit(0))))
    return per_run.groupBy(size, "intent").agg(F.avg("new_examples").alias("new_examples"))


def pivot_intents(summary: DataFrame, intents: Sequence[str] | None = None,
                  values: Sequence[str] = ("precision", "recall", "f1"), size: str = "train_n",
                  max_intents: int = 1_000) -> DataFrame:
    """EVA-9: one row per training size and for each intent a column
    ``<intent>_<value>`` per metric.

    Without ``intents`` they are discovered: the first ``max_intents`` names
    in order get columns. Further ones, and with a list those outside it, are
    cells of the map column ``others`` (intent -> values), so nothing is lost;
    the column exists only if there are any."""
    if intents is None:  # one row an intent, at most max_intents of them
        named = summary.select("intent").where(F.col("intent").isNotNull()).distinct().orderBy("intent")
        intents = [r[0] for r in named.limit(max_intents).collect()]
    intents = sorted(intents)
    wide = summary.where(F.col("intent").isin(intents)).groupBy(size).pivot("intent", intents).agg(
        *[F.first(v).alias(v) for v in values])
    rest = summary.where(~F.coalesce(F.col("intent").isin(intents), F.lit(False)))
    if rest.isEmpty():
        return wide
    cells = rest.groupBy(size, F.coalesce("intent", F.lit("")).alias("_i")).agg(
        F.struct(*[F.first(v).alias(v) for v in values]).alias("_v"))
    others = cells.groupBy(size).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("others"))
    return wide.join(others, size, "full_outer")


def avg_growth(examples: DataFrame, baseline: DataFrame, keys=("train_n", "run"),
               split: str = "train_n") -> DataFrame:
    """EVA-10: per split the mean over runs of (corpus size - baseline
    size); the baseline is a small lookup (split, n)."""
    k = _k(keys)
    sizes = examples.groupBy(*k).agg(F.count(F.lit(1)).alias("_size"))
    j = sizes.join(broadcast_if_small(baseline.select(split, F.col("n").alias("_base"))), split)
    return j.groupBy(split).agg(F.avg(F.col("_size") - F.col("_base")).alias("avg_new_examples"))
