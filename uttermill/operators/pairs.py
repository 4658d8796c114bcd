"""Paraphrase-pair corpus build (SRC-4, PAIR-1..3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..session import materialize


def read_pairs(spark: SparkSession, path: str, fmt: str = "tsv", in_col: str = "sentence1",
               out_col: str = "sentence2", label_col: str | None = "label", keep=1,
               source: str | None = None) -> DataFrame:
    """SRC-4: a TSV or CSV pair file with a header, malformed lines dropped
    (those without the header's number of fields; ``scan_pairs`` returns
    them); rows with ``label_col == keep`` (all rows without a label column),
    renamed to input_text / target_text, prefix 'paraphrase'."""
    return scan_pairs(spark, path, fmt, in_col, out_col, label_col, keep, source)[0]


def scan_pairs(spark: SparkSession, path: str, fmt: str = "tsv", in_col: str = "sentence1",
               out_col: str = "sentence2", label_col: str | None = "label", keep=1,
               source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-4 with both channels: the pairs (see ``read_pairs``), and (source,
    line) of the lines that have not as many fields as the header. The file is
    parsed once, into the checkpoint folder, so that both are of one scan."""
    r = spark.read.option("header", True).option("sep", "\t" if fmt == "tsv" else ",")
    names = r.csv(path).columns  # the header alone is read
    bad = "_line"
    while bad in names:
        bad = "_" + bad
    schema = ", ".join(f"`{c}` string" for c in [*names, bad])
    rows = materialize(r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).schema(schema).csv(path))
    tag = source or path
    good = rows.where(F.col(f"`{bad}`").isNull()).drop(bad)
    return (select_pairs(good, in_col, out_col, label_col, keep, tag),
            rows.where(F.col(f"`{bad}`").isNotNull()).select(F.lit(tag).alias("source"), F.col(f"`{bad}`").alias("line")))


def select_pairs(df: DataFrame, in_col: str, out_col: str, label_col: str | None = None, keep=1,
                 source: str = "pairs") -> DataFrame:
    """The projection part of SRC-4 on an already loaded table."""
    if label_col:
        df = df.where(F.col(label_col).cast("string") == str(keep))
    return df.select(F.lit(source).alias("source"), F.lit("paraphrase").alias("prefix"),
                     F.col(in_col).cast("string").alias("input_text"),
                     F.col(out_col).cast("string").alias("target_text"))


def build_pairs(sources: Sequence[DataFrame]) -> DataFrame:
    """PAIR-1: union of pair sources (train and eval parts alike), rows with
    a null dropped."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.dropna(subset=["input_text", "target_text"])


def detokenise(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    for a, b in config.DETOKENISE:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """PAIR-2: the fixed detokenisation replacements on both text columns,
    in their fixed order."""
    return (pairs.withColumn("input_text", detokenise("input_text"))
            .withColumn("target_text", detokenise("target_text")))


def split_pairs(pairs: DataFrame, test: float = 0.25, seed=config.SEED) -> DataFrame:
    """PAIR-3: deterministic train/test split by a hash of the pair: the
    first 8 hex digits of md5(seed|input|target) as a fraction of 2^32."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "input_text", "target_text")), 1, 8), 16, 10)
    frac = h.cast("double") / float(2 ** 32)
    return pairs.withColumn("split", F.when(frac < test, "test").otherwise("train"))
