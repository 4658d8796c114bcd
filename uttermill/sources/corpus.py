"""SRC-1..3: read block-format corpora.

Files are read line by line in splits of any size. A task passes once over its
lines in order and notes for each the last block header (``- intent:`` or
``- regex:``) above it; lines before a split's first header get the last one of
the splits before it, from a table with a row a split. So a file may be larger
than a task's memory, and no line is shuffled. Within one file a repeated
intent replaces the earlier block; the files of a folder add up. Position
``pos`` = file number x 2^40 + the line's byte offset (+ the piece's number),
so positions are unique and keep the order of the files.

Clean text (SRC-1), per example: ``(...)`` groups deleted (also ordinary
parentheses), ``[`` and ``]`` deleted, ``" -"`` replaced by ``" "``, then
split on ``"- "`` with empty pieces dropped. Raw text (SRC-2): the example
split on ``"- "`` only. Entities (SRC-3): every ``[surface](type)`` mark per
intent, distinct, in first-seen order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..session import broadcast_if_small, materialize

FILE_FACTOR = 1 << 40
HEADER = r"^- (intent|regex): "


def _carry(batches):
    """Lines in order -> the same with their byte offset and the offset and
    text of the header above them within the split (null before the first)."""
    split, at, head_at, head = None, 0, None, None
    for b in batches:
        lines = b.column("value")
        path, block = b.column("_file").to_pylist(), b.column("_block").to_pylist()
        size = pc.binary_length(lines).to_numpy(zero_copy_only=False) + 1
        is_head = pc.match_substring_regex(lines, HEADER).to_numpy(zero_copy_only=False)
        # a batch may hold the ends and beginnings of several splits
        key = list(zip(path, block))
        cuts = [0] + [i for i in range(1, len(key)) if key[i] != key[i - 1]] + [len(key)]
        offsets, heads_at, heads = [], [], []
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if key[lo] != split:
                # a later split leaves out the line that its block begins in
                split, at, head_at, head = key[lo], block[lo] + (block[lo] > 0), None, None
            ends = at + np.cumsum(size[lo:hi])
            own = ends - size[lo:hi]
            which = np.maximum.accumulate(np.where(is_head[lo:hi], np.arange(hi - lo), -1))
            text = lines.slice(lo, hi - lo)
            offsets.append(pa.array(own))
            found = text.take(pa.array(np.maximum(which, 0)))
            heads_at.append(pa.array([head_at if w < 0 else int(own[w]) for w in which.tolist()], pa.int64()))
            heads.append(pc.if_else(pa.array(which >= 0), found, pa.scalar(head, pa.string())))
            at = int(ends[-1])
            if which[-1] >= 0:
                head_at, head = int(own[which[-1]]), text[int(which[-1])].as_py()
        if offsets:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.concat_arrays(offsets), pa.concat_arrays(heads_at), pa.concat_arrays(heads)],
                [*b.schema.names, "_at", "_head_at", "_head"])


def _block_lines(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """Example lines with their block: partition columns, _file, _kind,
    _name, _head_at, pos and _ex; of an intent repeated in a file only the
    last block."""
    r = spark.read.option("lineSep", "\n")
    if base_path:
        r = r.option("basePath", base_path)
    lines = r.text(path).select("*", F.col("_metadata.file_path").alias("_file"),
                                F.col("_metadata.file_block_start").alias("_block"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    own = lines.mapInArrow(_carry, f"{fields}, _at long, _head_at long, _head string")
    # headers alone: the last one of each split, for the splits behind it
    blocks = materialize(own.groupBy("_file", "_block").agg(
        F.max(F.when(F.col("_head_at").isNotNull(), F.struct("_head_at", "_head"))).alias("_last")))
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    number = Window.orderBy("_file")
    files = blocks.select("_file").distinct().withColumn("_no", F.row_number().over(number) - 1)
    before = (blocks.withColumn("_above", F.last("_last", ignorenulls=True).over(w)).drop("_last")
              .join(files, "_file"))
    # a row a split and file
    named = own.join(broadcast_if_small(before), ["_file", "_block"])
    head_at = F.coalesce("_head_at", "_above._head_at")
    head = F.coalesce("_head", "_above._head")
    x = named.withColumn("_head_at", head_at).withColumn("_head", head).where(F.col("_head").isNotNull())
    x = x.select("*", F.regexp_extract("_head", HEADER, 1).alias("_kind"),
                 F.trim(F.regexp_extract("_head", r"^- (?:intent|regex): (.*)$", 1)).alias("_name"))
    heads = x.where(F.col("_at") == F.col("_head_at"))
    last = broadcast_if_small(heads.where(F.col("_kind") == "intent").groupBy("_file", "_name").agg(
        F.max("_head_at").alias("_keep_at")))
    ex = F.regexp_extract("value", r"^\s+- (.*)$", 1)
    x = x.where(F.col("value").rlike(r"^\s+- ")).join(last, ["_file", "_name"], "left")
    x = x.where((F.col("_kind") != "intent") | (F.col("_head_at") == F.col("_keep_at")))
    return x.withColumn("pos", F.col("_no") * FILE_FACTOR + F.col("_at")).withColumn("_ex", ex).drop(
        "value", "_block", "_above", "_no", "_at", "_head", "_keep_at")


def read_corpus_lines(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """Example lines of every intent block: keys (partition columns), _file,
    intent, pos, _ex (annotations kept)."""
    lines = _block_lines(spark, path, base_path).where(F.col("_kind") == "intent")
    return lines.withColumnRenamed("_name", "intent").drop("_kind", "_head_at")


def clean_examples(lines: DataFrame, src: str = "_ex") -> DataFrame:
    """SRC-1 clean-up of example text (see module doc), one row per piece."""
    t = F.regexp_replace(F.col(src), r"\([^)]*\)", "")
    t = F.translate(t, "[]", "")
    t = F.replace(t, F.lit(" -"), F.lit(" "))
    return (lines.select("*", F.posexplode(F.split(t, "- ")).alias("_piece", "text"))
            .where(F.col("text") != "")
            .withColumn("pos", F.col("pos") + F.col("_piece")).drop("_piece"))


def raw_examples(lines: DataFrame, src: str = "_ex") -> DataFrame:
    """SRC-2: annotations kept, split on ``"- "`` only."""
    return (lines.select("*", F.posexplode(F.split(F.col(src), "- ")).alias("_piece", "raw"))
            .where(F.col("raw") != "")
            .withColumn("pos", F.col("pos") + F.col("_piece")).drop("_piece"))


def read_corpus(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """SRC-1: rows (partition keys..., intent, pos, text)."""
    lines = read_corpus_lines(spark, path, base_path)
    return clean_examples(lines).drop("_ex", "_file")


def read_raw(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """SRC-2: rows (partition keys..., intent, pos, raw)."""
    lines = read_corpus_lines(spark, path, base_path)
    return raw_examples(lines).drop("_ex", "_file")


def extract_entities(raw: DataFrame, keys=(), raw_col: str = "raw") -> DataFrame:
    """SRC-3: per (keys, intent) the distinct ``[surface](type)`` marks in
    first-seen order: entity, surface, etype, ord (1-based)."""
    k = list(keys)
    m = raw.select(*k, "intent", "pos",
                   F.posexplode(F.regexp_extract_all(F.col(raw_col), F.lit(config.ENTITY_PATTERN), 0))
                   .alias("_i", "entity"))
    first = m.groupBy(*k, "intent", "entity").agg(F.min(F.struct("pos", "_i")).alias("_first"))
    w = Window.partitionBy(*k, "intent").orderBy("_first")
    surface = F.translate(F.regexp_replace("entity", r"\([^)]*\)", ""), "[]", "")
    etype = F.regexp_replace(F.regexp_replace("entity", r"\[[^)]*\]", ""), r"^\(|\)$", "")
    return first.select(*k, "intent", "entity", surface.alias("surface"), etype.alias("etype"),
                        F.row_number().over(w).alias("ord"))


def read_regex_features(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """Regex feature blocks: (partition keys..., name, pattern)."""
    lines = _block_lines(spark, path, base_path).where(F.col("_kind") == "regex")
    return lines.select(*[c for c in lines.columns if not c.startswith("_") and c != "pos"],
                        F.col("_name").alias("name"), F.col("_ex").alias("pattern"))
