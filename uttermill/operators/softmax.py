"""TRI-1: a linear softmax classifier on character n-grams.

Features are the character n-grams (1 to 4) inside word bounds: each word of
the lower-cased text with a blank on either side. They are hashed to
``BUCKETS`` numbers, counted, and scaled to unit length; a constant is the
bias. The models of all splits are trained at once by batch gradient descent:
one table holds the weights by (run keys, feature, class), an iteration joins it
with the features, turns the sums into probabilities, sums the gradient by
(run keys, feature, class) and writes the new table to the checkpoint folder,
so lineage stays short and lost executors cost one iteration at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

GRAMS = (1, 4)
#: Hash buckets: the first four hexadecimal digits of a gram's md5.
BUCKETS = 1 << 16
ITERATIONS, RATE, DECAY = 4, 2.0, 0.01
#: Digits that decide between classes; equal ones go to the smaller name.
TIE_DIGITS = 9


def char_grams(text: Column, sizes=GRAMS) -> Column:
    """The n-grams of all words, repeats included."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def grams(w):
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.flatten(F.transform(F.sequence(F.lit(sizes[0]), F.least(F.lit(sizes[1]), F.length(p))), lambda n: F.transform(
            F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substr(p, i, n))))

    return F.flatten(F.transform(words, grams))


def features(df: DataFrame, ids, text: str = "text") -> DataFrame:
    """ids, f (bucket, -1 for the bias) and x of each row; the rows of one
    text are computed once."""
    ids = list(ids)
    texts = df.select(F.col(text).alias("_t")).distinct()
    grams = texts.select("_t", F.explode(char_grams(F.col("_t"))).alias("g")).groupBy("_t", "g").agg(
        F.count(F.lit(1)).alias("n"))
    bucket = F.conv(F.substr(F.md5(F.col("g").cast("binary")), F.lit(1), F.lit(4)), 16, 10).cast("int")
    counts = grams.groupBy("_t", bucket.alias("f")).agg(F.sum("n").cast("double").alias("n"))
    length = counts.groupBy("_t").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l"))
    scaled = counts.join(length, "_t").select("_t", "f", (F.col("n") / F.col("l")).alias("x"))
    rows = df.select(*ids, F.col(text).alias("_t"))
    return rows.join(scaled, "_t").select(*ids, "f", "x").unionByName(
        rows.select(*ids, F.lit(-1).alias("f"), F.lit(1.0).alias("x")))


def _probabilities(x: DataFrame, examples: DataFrame, classes: DataFrame, weights: DataFrame, k: list[str],
                   ids: list[str]) -> DataFrame:
    """keys, ids, class and p for every example and class of its split."""
    sums = x.join(broadcast_if_small(weights), [*k, "f"]).groupBy(*k, *ids, "class").agg(
        F.sum(F.col("x") * F.col("w")).alias("z"))
    each = examples.join(broadcast_if_small(classes), k)
    each = each.join(sums, [*k, *ids, "class"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
    w = Window.partitionBy(*k, *ids)
    e = F.exp(F.col("z") - F.max("z").over(w))
    return each.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def train_softmax(base: DataFrame, keys, ids=("intent", "pos"), text: str = "text", iterations: int = ITERATIONS,
                  rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """The weights (keys, f, class, w) of every split's model after
    ``iterations`` steps from zero; ``ids`` (with intent) tell the examples of
    a split apart. The loss is the mean negative log-likelihood plus ``decay``
    / 2 times the squared weights."""
    k, ids = list(keys), list(ids)
    if not k:
        raise ValueError("run keys are needed: give a single model a constant one")
    base = materialize(base.select(*k, *ids, text))
    x = materialize(features(base, [*k, *ids], text))
    classes = materialize(base.select(*k, F.col("intent").alias("class")).distinct())
    size = base.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    examples = base.select(*k, *ids)
    weights = base.sparkSession.createDataFrame([], base.select(*k).schema.add("f", "integer").add("class", "string")
                                                .add("w", "double"))
    for _ in range(iterations):
        p = _probabilities(x, examples, classes, weights, k, ids)
        error = p.select(*k, *ids, "class", (F.col("p") - F.when(F.col("class") == F.col("intent"), 1.0).otherwise(0.0))
                         .alias("r"))
        slope = (x.join(error, [*k, *ids]).groupBy(*k, "f", "class").agg(F.sum(F.col("x") * F.col("r")).alias("g"))
                 .join(broadcast_if_small(size), k).select(*k, "f", "class", (-rate * F.col("g") / F.col("n")).alias("w")))
        kept = weights.withColumn("w", F.col("w") * (1 - rate * decay))
        weights = materialize(kept.unionByName(slope).groupBy(*k, "f", "class").agg(F.sum("w").alias("w")))
    return weights


def score_softmax(weights: DataFrame, candidates: DataFrame, keys, ids=("intent", "pos"), text: str = "text") -> DataFrame:
    """Candidates with ``pred`` (the likeliest class; equal ones: the smaller
    name) and ``conf`` (its probability). A candidate meets its split's weights
    in a hash join on the feature."""
    k, ids = list(keys), list(ids)
    classes = materialize(weights.select(*k, "class").distinct())
    x = features(candidates, [*k, *ids], text)
    p = _probabilities(x, candidates.select(*k, *ids), classes, weights, k, ids)
    best = p.groupBy(*k, *ids).agg(F.min(F.struct((-F.round("z", TIE_DIGITS)).alias("s"), "class", "p")).alias("_b"))
    return candidates.join(best, [*k, *ids]).select(*candidates.columns, F.col("_b.class").alias("pred"),
                                                    F.col("_b.p").alias("conf"))
