"""SNK-2 / SNK-3 and the evaluation-output writers used by round trips.

All writers partition by the run keys (``partitionBy``), so every run /
loop lands in its own folder and no writer gathers a run into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 10_000


def write_predictions(pred: DataFrame, root: str, keys=("train_n", "run"), mode: str = "overwrite") -> None:
    """Prediction logs in the record shape {text, intent,
    intent_prediction: {name, confidence}}: JSON lines under
    ``root/intent_errors`` and ``root/intent_successes``."""
    k = list(keys)
    rec = pred.select(*k, "text", "intent", F.struct(F.col("pred").alias("name"),
                                                     F.col("conf").alias("confidence")).alias("intent_prediction"),
                      (F.col("pred") != F.col("intent")).alias("_err"))
    for name, cond in (("intent_errors", F.col("_err")), ("intent_successes", ~F.col("_err"))):
        rec.where(cond).drop("_err").write.mode(mode).partitionBy(*k).json(f"{root.rstrip('/')}/{name}")


def write_reports(report: DataFrame, totals: DataFrame, confused: DataFrame | None, root: str,
                  keys=("train_n", "run"), mode: str = "overwrite") -> None:
    """Classification reports: one JSON object per run key with one entry
    per class ({precision, recall, f1-score, support, confused_with}) and
    the summary keys; the object size is bounded by the number of classes."""
    k = list(keys)
    r = report
    if confused is not None:
        cmap = confused.groupBy(*k, "intent").agg(
            F.map_from_entries(F.collect_list(F.struct("confused", F.col("n").cast("long")))).alias("confused_with"))
        r = r.join(cmap, k + ["intent"], "left")
    else:
        r = r.withColumn("confused_with", F.lit(None).cast("map<string,bigint>"))
    entry = F.to_json(F.struct("precision", "recall", F.col("f1").alias("f1-score"),
                               F.col("support").cast("long").alias("support"), "confused_with"))
    per = r.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("intent", entry))).alias("_m"))

    def avg_entry(p):
        return F.to_json(F.struct(F.col(f"{p}_precision").alias("precision"), F.col(f"{p}_recall").alias("recall"),
                                  F.col(f"{p}_f1").alias("f1-score"), F.col("support").cast("long").alias("support")))

    summ = totals.select(*k, F.create_map(F.lit("accuracy"), F.col("accuracy").cast("string"),
                                          F.lit("macro avg"), avg_entry("macro"),
                                          F.lit("weighted avg"), avg_entry("weighted")).alias("_s"))
    # values are JSON texts; splice them in unquoted
    obj = per.join(summ, k).select(*k, F.map_concat("_m", "_s").alias("_all"))
    body = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("_all"), lambda e: F.concat(
        F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2),
        F.lit(": "), e["value"])), ", "), F.lit("}"))
    obj.select(*k, body.alias("value")).write.mode(mode).partitionBy(*k).text(f"{root.rstrip('/')}/intent_report")


def write_filter_results(kept: DataFrame, root: str, keys=("train_n", "run"), mode: str = "overwrite",
                         chunk: int = CHUNK) -> None:
    """SNK-2: ``{intent: [texts]}`` JSON objects, one per line. A large
    intent is spread over several objects of at most about ``chunk`` texts
    (hash buckets), which readers merge back."""
    k = list(keys)
    n = kept.groupBy(*k, "intent").agg(F.count(F.lit(1)).alias("_n"))
    b = (kept.join(n, k + ["intent"])
         .withColumn("_b", F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.ceil(F.col("_n") / chunk)))))
    objs = (b.groupBy(*k, "intent", "_b").agg(F.collect_list("text").alias("_t"))
            .select(*k, F.to_json(F.create_map("intent", "_t")).alias("value")))
    objs.write.mode(mode).partitionBy(*k).text(f"{root.rstrip('/')}/filter_results")


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-3: CSV with a header; arrays / maps / structs as JSON text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    df.select(*cols).write.mode(mode).option("header", True).csv(path)
