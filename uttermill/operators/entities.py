"""Entities (ENT-1..3).

Mentions are found in Arrow batches: surfaces within the size check are a
broadcast dictionary, and an utterance is searched and its overlaps resolved
where it stands, without a row per place and without a shuffle. More surfaces
are found by a hash join: every place of an utterance has its opening gram (one
to three characters without case), every surface its own, and where they meet
the whole surface is verified. Of overlapping mentions the longest
stays (then the earlier entity, then the leftmost), which gives the spans that
annotation marks.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..session import broadcast_if_small, collect_if_small, materialize, spread

#: Characters of an opening gram, at most, and surfaces of an intent that are searched one by one, at most.
GRAM, FEW = 3, 32
_HIT = "struct<start:int,stop:int,rank:bigint,surface:string,etype:string>"


def _is_date(col):
    low = F.lower(col)
    names = list(config.MONTH_NAMES) + list(config.MONTH_SHORT)
    cond = F.lit(False)
    for m in names:
        cond = cond | low.contains(m)
    return cond


def expand_entities(entities: DataFrame, keys=(), camel_case: bool = True) -> DataFrame:
    """ENT-1: surface variants of each ``[surface](type)`` entity, in order:
    the entity; with ``/`` the versions with a blank and with ``-``; the
    CamelCase words joined by blanks plus ``(type)`` when the entity is not a
    date (``camel_case=False`` never adds it, as the reference's date test
    always fires); with ``.java`` the versions ``' .java'`` and ``'. java'``.
    Output: keys, intent, ord, variant, vord."""
    e = F.col("entity")
    camel = F.regexp_extract_all(e, F.lit(config.CAMEL_PATTERN), 0)
    etype = F.regexp_extract(e, r"(\([^)]*\))", 1)
    cands = [
        e,
        F.when(e.contains("/"), F.replace(e, F.lit("/"), F.lit(" "))),
        F.when(e.contains("/"), F.replace(e, F.lit("/"), F.lit("-"))),
        (F.when((F.size(camel) > 0) & ~_is_date(e), F.concat(F.array_join(camel, " "), etype))
         if camel_case else F.lit(None).cast("string")),
        F.when(e.contains(".java"), F.replace(e, F.lit(".java"), F.lit(" .java"))),
        F.when(e.contains(".java"), F.replace(e, F.lit(".java"), F.lit(". java"))),
    ]
    k = list(keys)
    return (entities.select(*k, "intent", "ord", F.posexplode(F.array(*cands)).alias("vord", "variant"))
            .where(F.col("variant").isNotNull()))


def _surface_type(variant_col: str = "variant"):
    v = F.col(variant_col)
    surface = F.translate(F.regexp_replace(v, r"\([^)]*\)", ""), "[]", "")
    etype = F.regexp_replace(v, r"\[[^)]*\]", "")
    return surface, etype


def _surfaces(variants: DataFrame, keys) -> DataFrame:
    """Distinct surfaces of each intent: s, low, etype, gram, and rank (longest
    first, then entity order). A surface of several entities is the first one's."""
    surface, etype = _surface_type()
    e = variants.select(*keys, "intent", "ord", "vord", surface.alias("s"), etype.alias("etype")).where(F.col("s") != "")
    one = e.groupBy(*keys, "intent", "s").agg(F.min(F.struct("ord", "vord", "etype")).alias("_first"))
    low = F.lower("s")
    # a number that sorts by length (descending), then order, then variant
    rank = ((F.lit(1 << 20) - F.least(F.length("s"), F.lit(1 << 20))).cast("long") * (1 << 42)
            + F.col("_first.ord").cast("long") * 8 + F.col("_first.vord"))
    return one.select(*keys, "intent", "s", low.alias("low"), "_first.etype", F.length("s").alias("n"),
                      rank.alias("rank"), F.substr(low, F.lit(1), F.lit(GRAM)).alias("gram"))


def find_hits(examples: DataFrame, variants: DataFrame, keys=(), text: str = "text") -> DataFrame:
    """All places at which a surface of the utterance's intent occurs, without
    case: utterance columns, start (from 0), stop, rank, surface, etype; also
    those that overlap."""
    k = list(keys)
    surfaces = _surfaces(variants, k)
    sizes = F.coalesce(surfaces.select(F.collect_set(F.length("gram"))).scalar(), F.array().cast("array<int>"))
    chars = F.split(F.col(text), "")
    with_chars = examples.withColumn("_ch", F.filter(chars, lambda c: c != ""))
    places = with_chars.select(*examples.columns, "_ch", F.explode(sizes).alias("_g"))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_ch") - F.col("_g"), F.lit(0))), lambda i: F.lower(
        F.concat(*[F.when(F.lit(j) < F.col("_g"), F.coalesce(F.get("_ch", i + j), F.lit(""))).otherwise("")
                   for j in range(GRAM)])))
    each = places.select(*examples.columns, F.posexplode(grams).alias("start", "gram"))
    met = each.join(broadcast_if_small(surfaces), [*k, "intent", "gram"])
    same = F.lower(F.substr(F.col(text), F.col("start") + 1, F.col("n"))) == F.col("low")
    return met.where(same).select(*examples.columns, "start", (F.col("start") + F.col("n")).alias("stop"), "rank",
                                  F.col("s").alias("surface"), "etype")


def _resolved(hits):
    """Non-overlapping hits, best rank first (then leftmost), in the order of their starts."""
    taken, out = [], []
    for h in sorted(hits or [], key=lambda h: (h["rank"], h["start"], h["surface"])):
        i = bisect_left(taken, (h["start"], h["stop"]))
        if (i == len(taken) or taken[i][0] >= h["stop"]) and (i == 0 or taken[i - 1][1] <= h["start"]):
            insort(taken, (h["start"], h["stop"]))
            out.append(h)
    return sorted(out, key=lambda h: h["start"])


class _Finder:
    """The surfaces of one intent: rows (s, low, etype, n, rank)."""

    def __init__(self, rows: list[tuple]):
        self.by: dict = {}
        for s, low, etype, n, rank in rows:
            self.by.setdefault((low, n), []).append((rank, s, etype))
        self.sizes = sorted({n for _, n in self.by})
        self.grams: dict = {}
        for low, n in self.by:
            self.grams.setdefault(low[:min(GRAM, self.sizes[0])], []).append((low, n))

    def hits(self, text: str) -> list[dict]:
        """All places of the surfaces in ``text`` without case, also overlapping ones."""
        low, found = text.lower(), []
        if len(low) != len(text) or "Σ" in text:  # lower case is not letter by letter
            for n in self.sizes:
                found.extend((i, key) for i in range(len(text) - n + 1) if (key := (text[i:i + n].lower(), n)) in self.by)
        elif len(self.by) <= FEW:
            for key in self.by:
                if len(key[0]) == key[1]:
                    i = low.find(key[0])
                    while i >= 0:
                        found.append((i, key))
                        i = low.find(key[0], i + 1)
        else:
            g = min(GRAM, self.sizes[0])
            found = [(i, key) for i in range(len(low) - g + 1) if low[i:i + g] in self.grams
                     for key in self.grams[low[i:i + g]] if len(key[0]) == key[1] and low.startswith(key[0], i)]
        return [{"start": i, "stop": i + key[1], "rank": rank, "surface": s, "etype": etype}
                for i, key in found for rank, s, etype in self.by[key]]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("rank", pa.int64()), ("surface", pa.string()),
                             ("etype", pa.string())]))


def _with_spans(examples: DataFrame, variants: DataFrame, keys, text: str) -> DataFrame:
    """``examples`` with ``_spans``, the resolved hits (null without any)."""
    k = [*keys, "intent"]
    rows = collect_if_small(_surfaces(variants, keys).select(*k, "s", "low", "etype", "n", "rank"))
    if rows is None:
        return _with_joined_spans(examples, variants, keys, text)
    groups: dict = {}
    for row in rows:
        groups.setdefault(tuple(row[:len(k)]), []).append(tuple(row[len(k):]))
    shared = examples.sparkSession.sparkContext.broadcast(
        {key: _Finder(own) for key, own in groups.items() if None not in key})

    def run(batches):
        for b in batches:
            spans = [_resolved(shared.value[key].hits(t)) or None if t is not None and key in shared.value else None
                     for t, *key_ in zip(b.column(text).to_pylist(), *[b.column(c).to_pylist() for c in k])
                     for key in (tuple(key_),)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, _SPANS)], [*b.schema.names, "_spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema.fields)
    return spread(examples).mapInArrow(run, f"{fields}, _spans array<{_HIT}>")


def _with_joined_spans(examples: DataFrame, variants: DataFrame, keys, text: str) -> DataFrame:
    """An utterance's hits are no more than its places times the lengths of
    surfaces that end in each other."""
    own = materialize(examples.withColumn("_rid", F.monotonically_increasing_id()))
    k = list(keys)
    need = list(dict.fromkeys([*k, "intent", text, "_rid"]))
    hits = find_hits(own.select(need), variants, keys, text)
    resolve = F.udf(_resolved, f"array<{_HIT}>", useArrow=True)
    spans = hits.groupBy("_rid").agg(resolve(F.collect_list(F.struct(
        "start", "stop", "rank", "surface", "etype"))).alias("_spans"))
    return own.join(spans, "_rid", "left").drop("_rid")


def mention_spans(examples: DataFrame, variants: DataFrame, keys=(), text: str = "text") -> DataFrame:
    """ENT-2: the mentions of each utterance after overlaps are resolved:
    utterance columns, start (from 0), stop, mention (as written), surface, etype."""
    found = _with_spans(examples, variants, keys, text).where(F.col("_spans").isNotNull())
    m = found.select(*examples.columns, F.explode("_spans").alias("_m"))
    return m.select(*examples.columns, "_m.start", "_m.stop",
                    F.substr(F.col(text), F.col("_m.start") + 1, F.col("_m.stop") - F.col("_m.start")).alias("mention"),
                    "_m.surface", "_m.etype")


def find_mentions(examples: DataFrame, variants: DataFrame, keys=(), text: str = "text") -> DataFrame:
    """ENT-2, counts: per utterance and entity surface of its intent, the
    number of case-insensitive (non-overlapping) occurrences of that surface,
    whatever other surfaces overlap it; zero counts omitted.
    Output: utterance columns + surface, etype, n."""
    surfaces = broadcast_if_small(_surfaces(variants, keys).select(*keys, "intent", "s", "etype"))
    parts = F.size(F.split(F.lower(F.col(text)), F.concat(F.lit("\\Q"), F.lower("s"), F.lit("\\E")), -1))
    return (examples.join(surfaces, [*keys, "intent"])
            .select(*examples.columns, F.col("s").alias("surface"), "etype", (parts - 1).cast("long").alias("n"))
            .where(F.col("n") > 0))


def annotate(examples: DataFrame, variants: DataFrame, keys=(), text: str = "text") -> DataFrame:
    """ENT-3: mark each mention as ``[mention](type)``: surfaces longest
    first, matched case-insensitively as literals, each occurrence once,
    never inside an earlier mark; a match equal to the type string is left
    as it is. Output: examples + ``annotated``."""
    spans = _with_spans(examples, variants, keys, text)
    t = F.col(text)

    def mark(acc, m):
        said = F.substr(t, m["start"] + 1, m["stop"] - m["start"])
        marked = F.when(said == m["etype"], said).otherwise(F.concat(F.lit("["), said, F.lit("]"), m["etype"]))
        return F.struct(F.concat(acc["done"], F.substr(t, acc["at"] + 1, m["start"] - acc["at"]), marked).alias("done"),
                        m["stop"].alias("at"))

    done = F.aggregate(F.coalesce("_spans", F.array().cast(f"array<{_HIT}>")),
                       F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), mark,
                       lambda acc: F.concat(acc["done"], F.substr(t, acc["at"] + 1, F.length(t))))
    return spans.select(*examples.columns, done.alias("annotated"))
