"""Line dedup by distinct-site spread (DataFrame functions only).

A HyperLogLog sketch of the sites is kept for each line hash and merged by
aggregation. Lines whose estimate lies within the sketch's error of
``min_sites`` get an exact distinct count; a line on ``min_sites`` sites or
more is cross-site boilerplate. Of a boilerplate line only the first
occurrence (smallest id, then position) stays.

Lines are the parts of a text between newlines, compared without the blanks
around them (md5 of the trimmed line); lines without a word are never counted
or removed. A null text has no lines and stays null; a null site is one site
of its own; repeated rows (same id and text) are one document whose lines are
treated alike; an empty table gives an empty table; columns of ``docs`` stay,
``text`` alone is rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

MIN_SITES = 10
#: log2 of the sketch's registers, and standard errors that count as near.
SKETCH_BITS = 12
NEAR_ERRORS = 3.0
#: Parts that the occurrences of one line are dealt to before any join on the
#: line, so that a line in very many documents is spread over as many tasks.
SALTS = 32

BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame, id_col: str = "doc_id", site: str = "source",
                text: str = "text") -> DataFrame:
    """key (id, md5 of the text), site, pos, h (16-byte hash) and salt of every
    line that has a word; a document has one salt."""
    t = F.col(f"`{text}`")
    lines = docs.select(
        F.struct(F.col(f"`{id_col}`").alias("id"), F.md5(t).alias("md5")).alias("key"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{site}`").cast("string")), F.lit("")).alias("site"),
        F.posexplode(_lines(t)).alias("pos", "line"))
    trimmed = F.btrim(F.col("line"), F.lit(BLANKS))
    return lines.select("key", "site", "pos", trimmed.alias("line")).where("line <> ''").select(
        "key", "site", "pos", F.unhex(F.md5(F.col("line"))).alias("h"),
        F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))


def _every_salt(rows: DataFrame) -> DataFrame:
    """``rows`` (a row a line) once for each part of its occurrences."""
    return rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))


def candidates(lines: DataFrame, min_sites: int = MIN_SITES, sketch_bits: int = SKETCH_BITS,
               near_errors: float = NEAR_ERRORS) -> DataFrame:
    """h of the lines whose estimate may reach ``min_sites`` sites, and whether
    it is so near that an exact count decides."""
    spread = lines.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(sketch_bits))).alias("sites"))
    margin = max(1.0, near_errors * 1.04 / 2 ** (sketch_bits / 2) * min_sites)
    return spread.where(F.col("sites") >= min_sites - margin).select(
        "h", (F.col("sites") < min_sites + margin).alias("near"))


def removals(hits: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """key and ``drops`` (sorted line positions to remove) from the occurrences
    of the candidates: all but the first one of each line on at least
    ``min_sites`` sites."""
    # (line, site) pairs are made distinct map-side first, so a hot line costs a row a task and site
    exact = (hits.where("near").select("h", "site").distinct()
             .groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h"))
    wide = hits.where("NOT near").unionByName(
        hits.where("near").join(_every_salt(exact), ["h", "salt"], "left_semi"))
    # the first of each part, then of the parts
    first = (wide.groupBy("h", "salt").agg(F.min(F.struct("key", "pos")).alias("first"))
             .groupBy("h").agg(F.min("first").alias("first")))
    return (wide.join(_every_salt(first), ["h", "salt"]).where(F.struct("key", "pos") != F.col("first"))
            .groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("drops")))


def dedup(docs: DataFrame, id_col: str = "doc_id", site: str = "source", text: str = "text",
          min_sites: int = MIN_SITES, counts: bool = False, **sketch) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; with ``counts``
    the columns n_lines (parts between newlines) and n_removed follow."""
    lines = occurrences(docs, id_col, site, text)
    found = _every_salt(candidates(lines, min_sites, **sketch))
    hits = written(lines.join(found, ["h", "salt"]), "line-hits")  # three branches read them
    drops = removals(hits, min_sites)
    key, out = fresh("line_key", docs.columns), fresh("line_drops", docs.columns)
    t = F.col(f"`{text}`")
    keyed = docs.withColumn(key, F.struct(F.col(f"`{id_col}`").alias("id"), F.md5(t).alias("md5")))
    joined = keyed.join(drops.select(F.col("key").alias(f"{out}_key"), F.col("drops").alias(out)),
                        F.col(key).eqNullSafe(F.col(f"{out}_key")), "left")
    parts = _lines(t)
    kept = F.transform(F.array(parts), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(out)), lambda i: x[i]), "\n"))[0]
    if counts:
        joined = joined.select(
            "*", F.when(t.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
            F.when(F.col(out).isNull(), 0).otherwise(F.size(out)).cast("long").alias("n_removed"))
    done = joined.withColumn(text, F.when(F.col(out).isNull(), t).otherwise(kept))
    return done.drop(key, out, f"{out}_key")
