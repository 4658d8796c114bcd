"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Tokens are letter runs and numbers, in two views. In the template view
capitalised words become a name placeholder, numbers a number placeholder, and
units after a number a unit placeholder; the plain view has words without case
(names too) and the placeholders of numbers and units, so that a passage whose
case was changed still matches. Windows of five tokens (at least two of them
words) are hashed and joined with the benchmark's. A document hits an item
where, in one region of the document, at least ``min_share`` of the item's
windows of one view match and the values in the placeholders are consistent:
each value of the item stands for one value of the document (equal for a
verbatim leak, other values for a re-parameterised question). Of an item window
that hits several places the one on the region's commonest diagonal counts; a
region in which ``min_share`` of the windows have the item's own values is
verbatim and needs no vote. Other names in another case match in neither view.

Documents stream past the benchmark's windows, which are broadcast only if
they are at most ``BROADCAST_WINDOWS`` rows and ``BROADCAST_BYTES`` bytes of
tokens (counted first). A larger benchmark is joined by a shuffle of (id, pos,
hash) alone; the tokens of the windows that met are then taken from the texts
that have any. Both ways give the same rows.

Null texts have no tokens. Items of fewer than five tokens, or without a
window of two words, never match. Rows with one id are one document or item;
empty tables give empty results; other columns are ignored by ``leaks`` and
kept by ``keep_clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, fresh, row_key, written

WINDOW = 5
MIN_SHARE = 0.8
MIN_CONSISTENT = 0.8
MIN_WORDS = 2
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 64 << 20

#: Units that count after a number (fixed values, lower case).
UNITS = ["km", "m", "cm", "mm", "mile", "miles", "kg", "g", "mg", "pound", "pounds", "l", "ml", "liter",
         "liters", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week",
         "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent",
         "cents", "percent", "degrees", "kmh", "mph"]
TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def fold(t: Column) -> Column:
    """Without case: in upper case, in which "ß" and "SS" agree."""
    return F.upper(t)


def caseless(toks: Column) -> Column:
    """The tokens without case, with placeholders for numbers and units."""
    def number(t):
        return t.substr(1, 1).between("0", "9")

    def one(t, i):
        unit = F.lower(t).isin(UNITS) & (i > 0) & number(F.get(toks, i - 1))
        return F.when(number(t), "<num>").when(unit, "<unit>").otherwise(fold(t))

    return F.transform(toks, one)


def token_hashes(toks: Column) -> Column:
    """(t, p): a hash of each token in the template and in the plain view; the
    lowest bit says whether it is a word there."""
    def plain(t):
        return F.when(t.startswith("<"), F.shiftleft(F.xxhash64(t), 1)).otherwise(
            F.shiftleft(F.xxhash64(t), 1).bitwiseOR(F.lit(1)))

    def template(t, p):
        capital = F.lower(t).substr(1, 1) != t.substr(1, 1)
        return F.when(capital, F.shiftleft(F.xxhash64(F.lit("<name>")), 1)).otherwise(p)

    return bound(toks, lambda t: bound(F.transform(caseless(t), plain), lambda p: F.struct(
        F.zip_with(t, p, template).alias("t"), p.alias("p"))))


def windows(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, pos and (through ``toks``) the values of every window, with its hash
    in both views: ``template`` and ``plain``, null for a view without enough
    words. The windows are built after the explode, by element access that
    Spark compiles, not in a lambda."""
    toks = rows.select(F.col(f"`{id_col}`").alias("id"), tokens(F.col(f"`{text}`")).alias("toks"))
    views = toks.select("id", "toks", token_hashes(F.col("toks")).alias("hs"))
    hashed = views.select("id", "toks", F.col("hs.t").alias("ts"), F.col("hs.p").alias("ps"))
    each = hashed.select("id", "toks", "ts", "ps", F.posexplode("ts").alias("pos", "t0")).where(
        F.col("pos") <= F.size("ts") - WINDOW)

    def window(hs):
        part = [F.get(hs, F.col("pos") + k) for k in range(WINDOW)]
        words = sum((p.bitwiseAND(F.lit(1)) for p in part[1:]), part[0].bitwiseAND(F.lit(1)))
        return F.when(words >= MIN_WORDS, F.xxhash64(*part))

    return each.select("id", "toks", "pos", window("ts").alias("template"), window("ps").alias("plain"))


def met_by_shuffle(seen: DataFrame, items: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The hits of a benchmark that is too large to broadcast. Only (id, pos,
    hash) of a document's windows are shuffled; a text that has hits gives
    their tokens afterwards (its list of positions is no longer than the text)."""
    met = written(seen.select("id", "pos", "h").distinct().join(items, "h")
                  .select("id", "pos", "h", "item", "view", "item_pos", "item_size", "n_windows", "item_words"),
                  "leak-positions")
    places = met.groupBy("id").agg(F.collect_set("pos").alias("places")).withColumnRenamed("id", "place_id")
    toks = docs.select(F.col(f"`{id_col}`").alias("id"), tokens(F.col(f"`{text}`")).alias("toks"))
    held = toks.join(places, F.col("id").eqNullSafe(F.col("place_id")))

    def at_places(hs):
        def hash_at(view, p):
            return F.xxhash64(*[F.get(hs[view], p + k) for k in range(WINDOW)])
        return F.transform(F.filter("places", lambda p: p <= F.size("toks") - WINDOW), lambda p: F.struct(
            p.alias("pos"), F.slice("toks", p + 1, WINDOW).alias("words"),
            F.array_distinct(F.array(hash_at("t", p), hash_at("p", p))).alias("hs")))

    # rows that share an id have their own tokens at a place: those with the hash count
    keyed = (held.select("id", F.explode(bound(token_hashes(F.col("toks")), at_places)).alias("w"))
             .select("id", "w.pos", "w.words", F.explode("w.hs").alias("h")))
    on = [F.col(f"m.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("id", "pos", "h")]
    return met.alias("m").join(keyed.alias("k"), on).select("m.*", "k.words")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
          item_col: str = "item_id", item_text: str = "text", min_share: float = MIN_SHARE,
          min_consistent: float = MIN_CONSISTENT, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each document and item that it holds: the ids, n_matched
    and n_windows (windows of the item, of the template view if that matches),
    and consistency (share of slot values that the chosen mapping explains; 1
    without slots and for verbatim copies)."""
    value = F.slice("toks", F.col("pos") + 1, WINDOW)
    views = F.array(*[F.struct(F.lit(v).alias("view"), F.col(c).alias("h"))
                      for v, c in enumerate(("template", "plain"))])
    items = windows(benchmark, item_col, item_text).select(
        F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.inline(views), value.alias("item_words"),
        F.size("toks").alias("item_size")).where(F.col("h").isNotNull()).distinct()
    sizes = items.groupBy("item", "view").agg(F.countDistinct("item_pos").alias("n_windows"))
    keys = [F.col(f"i.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("item", "view")]
    items = items.alias("i").join(sizes.alias("n"), keys).select("i.*", "n.n_windows")
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("item_words", "")))).first()
    # a window without capitals has one hash in both views, looked up once
    either = F.array("template", F.when(~F.col("plain").eqNullSafe(F.col("template")), F.col("plain")))
    seen = windows(docs, id_col, text).select("id", "toks", "pos", F.explode(either).alias("h")).where(
        F.col("h").isNotNull())
    cols = ["id", "item", "view", "pos", "item_pos", "item_size", "n_windows", "words", "item_words"]
    if n <= broadcast_windows and (size or 0) <= BROADCAST_BYTES:
        hits = seen.join(F.broadcast(items), "h").withColumn("words", value).select(cols)
    else:
        hits = met_by_shuffle(seen, items, docs, id_col, text).select(cols)
    hits = written(hits, "leak-windows")  # both branches below read them
    # regions: two families of diagonals, so that any shift below half an item falls into one
    shift = F.col("pos") - F.col("item_pos")
    regions = hits.withColumn("region", F.explode(F.array(
        F.struct(F.lit(0).alias("family"), F.floor(shift / F.col("item_size")).alias("at")),
        F.struct(F.lit(1).alias("family"), F.floor(shift / F.col("item_size") + 0.5).alias("at")))))
    group = ["id", "item", "view", "region"]
    same = F.transform("words", fold) == F.transform("item_words", fold)
    each = regions.groupBy(*group, "n_windows", "item_pos").agg(F.max(same).cast("int").alias("same"))
    full = each.groupBy(*group, "n_windows").agg(F.count("*").alias("n_matched"), F.sum("same").alias("n_same")).where(
        F.col("n_matched") >= min_share * F.col("n_windows"))
    # one hit of each item window: that on the diagonal with most hits of the region
    # (of equal ones, with most equal values), so that repetitions do not vote on each other's values
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in group]
    diagonal = Window.partitionBy(*group, "shift")
    best = Window.partitionBy(*group, "item_pos").orderBy(F.desc("hits"), F.desc("equal"), "shift", "words", "item_words")
    aligned = (regions.alias("r").join(full.alias("f"), on, "left_semi")
               .select(*group, "item_pos", "words", "item_words", shift.alias("shift"), same.cast("int").alias("same"))
               .withColumn("hits", F.count("*").over(diagonal)).withColumn("equal", F.sum("same").over(diagonal))
               .withColumn("nth", F.row_number().over(best)).where(F.col("nth") == 1))
    # values in the slots of the aligned windows: item value -> document value
    slots = aligned.select(*group, F.explode(F.arrays_zip("words", "item_words")).alias("s")).select(
        *group, fold(F.col("s.words")).alias("doc_value"), F.col("s.item_words").alias("item_value"))
    slots = slots.where(F.col("item_value").rlike(r"^[0-9\p{Lu}]") | F.lower("item_value").isin(UNITS))
    votes = slots.groupBy(*group, fold(F.col("item_value")).alias("item_value"), "doc_value").count()
    votes = votes.groupBy(*group, "item_value").agg(F.max("count").alias("best"), F.sum("count").alias("n"))
    slot = votes.groupBy(*group).agg((F.sum("best") / F.sum("n")).alias("consistency"))
    keys = [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    judged = (full.alias("f").join(slot.alias("s"), keys, "left")
              .select("f.*", F.when(F.col("n_same") >= min_share * F.col("n_windows"), 1.0).otherwise(
                  F.coalesce("s.consistency", F.lit(1.0))).alias("consistency"))
              .where(F.col("consistency") >= min_consistent))
    found = judged.groupBy("id", "item", "view").agg(
        F.max("n_matched").cast("long").alias("n_matched"),
        F.max("n_windows").cast("long").alias("n_windows"),
        F.max("consistency").alias("consistency"))
    first = F.min_by(F.struct("n_matched", "n_windows", "consistency"), "view")  # the template's, if it matches
    return found.groupBy("id", "item").agg(first.alias("kept")).select("id", "item", "kept.*").select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "n_matched", "n_windows", "consistency")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
               **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. Rows are told apart by
    id and text, so a leak in one row says nothing about others with its id."""
    key = fresh("leak_key", docs.columns)
    keyed = docs.withColumn(key, row_key(id_col, text))
    found = leaks(keyed.select(key, F.col(f"`{text}`").alias("text")), benchmark, key, **options)
    return keyed.join(found.select(key).distinct(), key, "left_anti").drop(key)
