"""Corpus set operations and sampling (SET-1..5) and the run grid (RUN-1).

A corpus is a DataFrame with the run keys, ``intent``, ``text`` and
``pos`` (first-seen order). Missing intents on one side behave as empty
lists. Random choices are md5 orders with a seed, so they are repeatable
and identical in any SQL engine that has ``md5``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import md5_order
from ..session import broadcast_if_small, materialize


def _k(keys) -> list[str]:
    return list(keys or ())


def experiment_grid(spark: SparkSession, sizes: Sequence[int] = config.TRAIN_SIZES,
                    runs: int = config.RUNS, loops: int = 1) -> DataFrame:
    """RUN-1: every (train_n, run, loop) of an experiment, as rows."""
    return (
        spark.range(1)
        .select(F.explode(F.array(*[F.lit(int(n)) for n in sizes])).alias("train_n"))
        .select("train_n", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
        .select("train_n", "run", F.explode(F.sequence(F.lit(1), F.lit(loops))).alias("loop"))
    )


def for_each_run(df: DataFrame, sizes: Sequence[int] = config.TRAIN_SIZES,
                 runs: int = config.RUNS) -> DataFrame:
    """Replicate rows once per (train_n, run) of a fixed, small grid (a
    generator over a literal array; the factor is the grid size)."""
    grid = F.array(*[F.struct(F.lit(int(n)).alias("train_n"), F.lit(r).alias("run"))
                     for n in sizes for r in range(1, runs + 1)])
    return df.select(F.explode(grid).alias("_g"), "*").select("_g.train_n", "_g.run", *df.columns)


def for_each_split(df: DataFrame, originals: DataFrame, keys=("train_n", "run")) -> DataFrame:
    """Replicate rows once per split that occurs in ``originals`` (its distinct
    run keys, one small array)."""
    k = list(keys)
    grid = originals.select(F.array_sort(F.collect_set(F.struct(*k)))).scalar()
    return df.select(F.explode(grid).alias("_g"), "*").select(*[F.col(f"_g.{c}") for c in k], *df.columns)


def merge_corpora(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    """SET-1: per intent the set union of both corpora (intents of either
    side kept). ``pos`` is the smallest position seen for the text."""
    k = _k(keys)
    cols = k + ["intent", "text", "pos"]

    def prep(d):
        return d.select(*k, "intent", "text",
                        (F.col("pos") if "pos" in d.columns else F.lit(None)).cast("long").alias("pos"))

    return (prep(a).unionByName(prep(b))
            .groupBy(*k, "intent", "text").agg(F.min("pos").alias("pos"))
            .select(*cols))


def subtract_corpus(base: DataFrame, new: DataFrame, keys=()) -> DataFrame:
    """SET-2: rows of ``new`` whose text is not in ``base`` for the same
    intent (bag semantics: duplicates of ``new`` stay)."""
    k = _k(keys)
    on = k + ["intent", "text"]
    b = broadcast_if_small(base.select(*on).distinct())
    return new.join(b, on, "left_anti")


def _top_by_md5(df: DataFrame, n: int, seed, keys) -> DataFrame:
    k = _k(keys)
    w = Window.partitionBy(*k, "intent").orderBy("_h", "text")
    return (_lowest(df.withColumn("_h", md5_order(seed, "text")), [*k, "intent"], n)
            .withColumn("pick", F.row_number().over(w))
            .where(F.col("pick") <= n)
            .drop("_h"))


def _lowest(df: DataFrame, group: list[str], n: int) -> DataFrame:
    """The rows that can be among the ``n`` smallest ``_h`` of their group, so
    that no window sorts all rows: counts by the first three digits tell up to
    which of them each group has its first ``n`` rows. Reads ``df`` twice."""
    start = F.substr("_h", F.lit(1), F.lit(3))
    names = [f"_g{i}" for i in range(len(group))]
    counts = df.groupBy(*[F.col(c).alias(g) for c, g in zip(group, names)], start.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = (counts.withColumn("_m", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_m") < n)
            .groupBy(*names).agg(F.max("_b").alias("_last")))
    same = F.lit(True)
    for c, g in zip(group, names):
        same = same & F.col(c).eqNullSafe(F.col(g))
    return (df.join(broadcast_if_small(materialize(last)), same).where(start <= F.col("_last"))
            .select(*df.columns))


def limit_per_intent(base: DataFrame, new: DataFrame, n: int = config.LIMIT_PER_INTENT,
                     seed=config.SEED, keys=()) -> DataFrame:
    """SET-3: at most ``n`` texts per intent of ``new`` that are not in
    ``base``, chosen in seeded md5 order. The top-n window is a group
    limit, so each map task keeps only n rows per intent before the shuffle."""
    return _top_by_md5(subtract_corpus(base, new, keys), n, seed, keys)


def one_per_intent(df: DataFrame, seed=config.SEED, keys=()) -> DataFrame:
    """SET-4: one seeded random text per intent."""
    return _top_by_md5(df, 1, seed, keys)


def fewshot_splits(corpus: DataFrame, sizes: Sequence[int] = config.TRAIN_SIZES,
                   runs: int = config.RUNS, seed=config.SEED, keys=(),
                   checkpoint: bool = True) -> DataFrame:
    """SET-5: for run r = 1..runs pick per intent the first max(sizes)
    texts in md5(seed|run|text) order; split train_n holds the first
    train_n of them (splits of one run are nested).

    Output: keys, train_n, run, intent, text, pos, rk (1-based pick rank).
    The picks are few (intents x max(sizes) x runs) and feed several later
    steps, so by default they are checkpointed once.
    """
    k = _k(keys)
    top = max(sizes)
    x = corpus.select(*k, "intent", "text", "pos",
                      F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    x = x.withColumn("_h", md5_order(seed, "run", "text"))
    w = Window.partitionBy(*k, "run", "intent").orderBy("_h", "text")
    x = x.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top).drop("_h")
    x = x.withColumn("train_n", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    x = x.where(F.col("rk") <= F.col("train_n")).select(
        *k, "train_n", "run", "intent", "text", "pos", "rk")
    return materialize(x) if checkpoint else x
