"""URL filters by a temporal list join.

Dated list entries (list, domain, time, active or not) become validity
intervals: an entry holds from its time until the next entry of the same list
and domain. Every capture is judged by the entries in force at its fetch time
on its host and all parent domains: an as-of join.

Intervals and captures meet on (domain, level, cell): time is cut into cells
of ``LEVELS`` widths, each ``FAN`` times the one below. An interval stands in the
few cells that cover it, large ones within and small ones at its ends; a capture
asks the cell around it on each level. So a capture meets the intervals that
hold it and those that end within its smallest cell, not all of a busy host; a list
is broadcast only where Spark's own size check allows. Entries of one list,
domain and time: the one that activates wins.

A null or unparsable URL has no host and meets no list; a null fetch time meets
no interval; entries without domain or time are ignored; repeated rows are
judged one by one; empty tables give no hits; other columns of the captures
stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: Seconds of the smallest cells, the widths of a level in those of the one
#: below, and the levels (about an hour, a day and a half, seven weeks).
CELL_SECONDS, FAN, LEVELS = 4096, 32, 3


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    h = F.lower(F.rtrim(h, F.lit(".")))
    return F.when(h != "", h)


def domains(h: Column) -> Column:
    """The host and its parent domains of at least two labels."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """list, domain, valid_from, valid_to (exclusive, null: open) of the times
    in which an entry is active. ``entries``: list, domain, at, active."""
    one = (entries.withColumn("at", F.col("at").cast("timestamp")).where("domain IS NOT NULL AND at IS NOT NULL")
           .groupBy(F.coalesce("list", F.lit("")).alias("list"), F.lower("domain").alias("domain"), "at")
           .agg(F.max("active").alias("active")).withColumn("slice", cell_of(F.col("at"))))
    # the next entry: in the same time slice, else the first of the next slice that has any
    keys = ["list", "domain"]
    within = Window.partitionBy(*keys, "slice").orderBy("at")
    slices = one.groupBy(*keys, "slice").agg(F.min("at").alias("first"))
    later = slices.select(*keys, "slice", F.lead("first").over(Window.partitionBy(*keys).orderBy("slice")).alias("later"))
    return (one.withColumn("next", F.lead("at").over(within)).where("active").join(later, [*keys, "slice"])
            .select(*keys, F.col("at").alias("valid_from"), F.coalesce("next", "later").alias("valid_to")))


def cell_of(at: Column, level: int = 0) -> Column:
    """Number of the cell of ``level`` around a timestamp."""
    return F.floor(F.unix_micros(at) / F.lit(CELL_SECONDS * 1_000_000 * FAN ** level)).cast("long")


def cells_around(at: Column) -> Column:
    """(level, cell) of every level around a timestamp."""
    return F.array(*[F.struct(F.lit(k).alias("level"), cell_of(at, k).alias("cell")) for k in range(LEVELS)])


def cover(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """``rows`` once for each (level, cell) that covers ``start`` to ``stop``
    (inclusive): at most 2 ``FAN`` cells a level, but for the top level."""
    def seq(level: int, lo: Column, hi: Column) -> Column:
        numbers = F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))

    lo, hi = fresh("lo", rows.columns), fresh("hi", rows.columns)
    rows = rows.withColumns({f"{lo}0": cell_of(start), f"{hi}0": cell_of(stop) + 1})
    parts = []
    for k in range(LEVELS - 1):
        a, b = F.col(f"{lo}{k}"), F.col(f"{hi}{k}")
        up, down = F.ceil(a / FAN).cast("long"), F.floor(b / FAN).cast("long")
        whole = up < down  # cells of the next level that lie within
        parts += [seq(k, a, F.when(whole, up * FAN).otherwise(b)), seq(k, F.when(whole, down * FAN).otherwise(b), b)]
        rows = rows.withColumns({f"{lo}{k + 1}": F.when(whole, up).otherwise(0),
                                 f"{hi}{k + 1}": F.when(whole, down).otherwise(0)})
    parts.append(seq(LEVELS - 1, F.col(f"{lo}{LEVELS - 1}"), F.col(f"{hi}{LEVELS - 1}")))
    ends = [f"{x}{k}" for x in (lo, hi) for k in range(LEVELS)]
    return rows.select("*", F.inline(F.concat(*parts))).drop(*ends)


def listed(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``lists``: the sorted names of the lists on which the
    host or a parent domain stood when it was fetched."""
    key, out = fresh("capture_key", captures.columns), fresh("lists", captures.columns)
    rows = captures.withColumn(key, F.struct(host(F.col(f"`{url}`")).alias("host"),
                                             F.col(f"`{at}`").cast("timestamp").alias("at")))
    distinct = rows.select(F.col(f"{key}.host").alias("host"), F.col(f"{key}.at").alias("at")).where(
        "host IS NOT NULL AND at IS NOT NULL").distinct()
    span = distinct.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    last = F.lit(span["b"]).cast("timestamp")
    held = intervals(entries).where(F.col("valid_from") <= last)
    start = F.greatest("valid_from", F.lit(span["a"]).cast("timestamp"))
    held = cover(held, start, F.greatest(F.least(F.coalesce("valid_to", last), last), start))
    asked = (distinct.select("host", "at", F.explode(domains(F.col("host"))).alias("domain"))
             .select("*", F.inline(cells_around(F.col("at")))))
    hits = (asked.join(held, ["domain", "level", "cell"])
            .where((F.col("valid_from") <= F.col("at"))
                   & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
            .groupBy("host", "at").agg(F.array_sort(F.collect_set("list")).alias(out))
            .select(F.struct("host", "at").alias(f"{out}_key"), out))
    joined = rows.join(hits, F.col(key) == F.col(f"{out}_key"), "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).drop(key, f"{out}_key")


def allowed(captures: DataFrame, entries: DataFrame, **columns) -> DataFrame:
    """The captures that stood on no list when they were fetched."""
    judged = listed(captures, entries, **columns)
    name = [c for c in judged.columns if c not in captures.columns][-1]
    return judged.where(F.size(name) == 0).drop(name)
