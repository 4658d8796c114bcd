"""SRC-5..8: evaluation outputs of an experiment tree.

- prediction logs (error / success files; a JSON array per file in the
  reference layout, JSON lines as written by ``sinks.results``);
- classification reports (one JSON object per file with dynamic keys);
- filter results (``{intent: [texts]}`` objects);
- run keys parsed from paths (``train_N/run_R/.../loop_L`` or
  ``train_n=N/run=R`` folders) and the experiment type / dataset names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from .. import config
from ..schemas import PREDICTION_RECORD, REPORT_ENTRY

SUMMARY_KEYS = ("accuracy", "macro avg", "weighted avg")


def with_grid_keys(df: DataFrame, path: str = "_file") -> DataFrame:
    """SRC-7: add train_n, run, loop (null where absent), exp_type and
    dataset parsed from a path column. The experiment folder is
    ``<exp_type>_train_...``; known mode names are matched longest first,
    so ``augment_and_human`` is not read as ``augment``."""
    p = F.col(path)

    def num(pattern: str) -> Column:
        v = F.regexp_extract(p, pattern, 1)
        return F.when(v != "", v.cast("int"))

    modes = sorted(config.MODES, key=len, reverse=True)
    seg = r"(?:/|$)"
    exp_dir = F.regexp_extract(p, r"/([^/]+)/train(?:_n=|_)\d+" + seg, 1)
    exp_type = F.regexp_extract(exp_dir, "^(" + "|".join(modes) + ")_", 1)
    dataset = F.regexp_extract(p, r"/([^/]+)/[^/]+/train(?:_n=|_)\d+" + seg, 1)
    return df.select(
        "*",
        num(r"/train(?:_n=|_)(\d+)" + seg).alias("train_n"),
        num(r"/run[=_](\d+)" + seg).alias("run"),
        num(r"/loop[=_](\d+)" + seg).alias("loop"),
        F.when(exp_type != "", exp_type).alias("exp_type"),
        F.when(dataset != "", dataset).alias("dataset"))


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _reader(spark: SparkSession, file_glob: str | None):
    r = spark.read.option("recursiveFileLookup", "true")
    return r.option("pathGlobFilter", file_glob) if file_glob else r


def read_predictions(spark: SparkSession, root: str, layout: str = "written") -> DataFrame:
    """SRC-5: all prediction logs under ``root``.

    layout 'tree' (reference): files ``intent_errors.json`` /
    ``intent_successes.json`` anywhere below ``root``, one JSON array each;
    layout 'written' (``sinks.results.write_predictions``): JSON lines under
    ``root/intent_errors`` and ``root/intent_successes``. Errors get
    outcome 'error', successes 'success'; a missing log contributes no rows.
    Output: _file, text, intent, pred, conf, outcome + parsed run keys."""
    parts = []
    for outcome, name in (("error", "intent_errors"), ("success", "intent_successes")):
        try:
            if layout == "tree":
                df = _reader(spark, f"{name}*.json").schema(PREDICTION_RECORD).option("multiLine", "true").json(root)
            else:
                df = _reader(spark, None).schema(PREDICTION_RECORD).json(f"{root.rstrip('/')}/{name}")
        except AnalysisException:
            continue
        parts.append(df.select(F.col("_metadata.file_path").alias("_file"), "text", "intent",
                               F.col("intent_prediction.name").alias("pred"),
                               F.col("intent_prediction.confidence").alias("conf"),
                               F.lit(outcome).alias("outcome")))
    if not parts:
        schema = (T.StructType().add("_file", T.StringType()).add("text", T.StringType())
                  .add("intent", T.StringType()).add("pred", T.StringType())
                  .add("conf", T.DoubleType()).add("outcome", T.StringType()))
        parts = [_empty(spark, schema)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_grid_keys(out)


def _json_objects(files: DataFrame, typ: str) -> DataFrame:
    """A file holds JSON lines, or one object over several lines (then its
    first line alone is not valid JSON)."""
    lines_mode = F.from_json(F.substring_index("value", "\n", 1), typ).isNotNull()
    return (files.select("_file", F.explode(F.when(lines_mode, F.split("value", "\n")).otherwise(F.array("value")))
                         .alias("value")).where(F.trim("value") != ""))


def _text_files(spark: SparkSession, root: str, layout: str, tree_glob: str, folder: str) -> DataFrame:
    if layout == "tree":
        df = _reader(spark, tree_glob).text(root, wholetext=True)
    else:
        df = _reader(spark, None).text(f"{root.rstrip('/')}/{folder}", wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("_file"), "value")


def parse_reports(files: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """SRC-6 on (``_file``, JSON text) rows: per-class rows without the
    summary keys, and the summary rows (accuracy, macro avg, weighted avg)."""
    entries = files.select("*", F.explode(F.from_json(F.col(text), "map<string,string>")).alias("key", "v"))
    per = (entries.where(~F.col("key").isin(*SUMMARY_KEYS))
           .select("*", F.from_json("v", REPORT_ENTRY).alias("r"))
           .select(*[c for c in files.columns if c != text], F.col("key").alias("intent"),
                   F.col("r.precision").alias("precision"), F.col("r.recall").alias("recall"),
                   F.col("r.`f1-score`").alias("f1"), F.col("r.support").alias("support"),
                   F.col("r.confused_with").alias("confused_with")))
    summ = entries.where(F.col("key").isin(*SUMMARY_KEYS))
    struct = F.from_json("v", REPORT_ENTRY)
    tot = (summ.groupBy(*[c for c in files.columns if c != text])
           .agg(F.max(F.when(F.col("key") == "accuracy", F.col("v").cast("double"))).alias("accuracy"),
                *[F.max(F.when(F.col("key") == k, struct[f])).alias(f"{p}_{n}")
                  for k, p in (("macro avg", "macro"), ("weighted avg", "weighted"))
                  for f, n in (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1"))],
                F.max(F.when(F.col("key") == "weighted avg", struct["support"])).alias("support")))
    return per, tot


def read_reports(spark: SparkSession, root: str, layout: str = "written") -> tuple[DataFrame, DataFrame]:
    """SRC-6: classification reports under ``root`` ('tree': files
    ``intent_report.json``; 'written': folder ``intent_report``)."""
    files = _text_files(spark, root, layout, "intent_report*.json", "intent_report")
    return parse_reports(with_grid_keys(_json_objects(files, "map<string,string>")))


def read_filter_results(spark: SparkSession, root: str, layout: str = "written") -> DataFrame:
    """SRC-8: ``{intent: [texts]}`` objects -> rows (run keys, intent,
    text). 'tree': files ``*filter_results.json``; 'written': folder
    ``filter_results``."""
    files = _text_files(spark, root, layout, "*filter_results*.json", "filter_results")
    objs = _json_objects(files, "map<string,array<string>>")
    rows = objs.select("_file", F.explode(F.from_json("value", "map<string,array<string>>")).alias("intent", "_t"))
    return with_grid_keys(rows.select("_file", "intent", F.explode("_t").alias("text")))
