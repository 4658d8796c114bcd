"""Expansion: synonym combinations, provenance, vector neighbours and
paraphrasing (EXP-3, EXP-5..9).

Combinations are generated, never held: each utterance's per-position
synonym lists give the product size, index ranges of at most ``CHUNK``
combinations are spread over tasks, and each index is decoded by mixed
radix (last position varies fastest, the order of a Cartesian product).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import ascii_fold, norm_paraphrase, tokens_space
from ..session import broadcast_if_small, spread
from .phrase_model import JoinedModel
from .vector_index import PROBES, VectorIndex

CHUNK = 100_000


def synonym_lists(tagged: DataFrame, id_cols, syn_col: str = "syns") -> DataFrame:
    """Per utterance the ordered array of per-position lists: the
    synonym list of a replaceable token, else the token itself."""
    lst = F.when(F.col("replaceable"), F.col(syn_col)).otherwise(F.array(F.col("token")))
    return (tagged.groupBy(*id_cols)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_pos", lst.alias("l")))),
                             lambda x: x["l"]).alias("lists")))


def expand_combinations(lists: DataFrame, id_cols, chunk: int = CHUNK,
                        max_per_example: int | None = None) -> DataFrame:
    """EXP-5: every combination of the per-position lists, joined by one
    blank, as rows (id columns, ``idx``, ``text``). No size limit unless
    ``max_per_example`` is given (then the first ones in product order)."""
    n = F.size("lists")
    sizes = F.transform("lists", lambda l: F.size(l).cast("long"))
    # products are capped at the largest index that the chunks can count to
    top = F.lit(2**62 if max_per_example is None else int(max_per_example)).cast("long")

    def times(acc, s):
        room = F.call_function("div", top, F.greatest(acc, F.lit(1).cast("long")))
        return F.when(s > room, top).otherwise(acc * s)

    total = F.aggregate(sizes, F.lit(1).cast("long"), times)
    x = lists.select(*id_cols, "lists", sizes.alias("_sz"), total.alias("_total"))
    if max_per_example is not None:
        x = x.withColumn("_total", F.least("_total", top))
    # suffix products: weight of position i = product of the sizes after i
    x = x.withColumn("_w", F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(
        F.slice("_sz", i + 1, F.greatest(n - i, F.lit(0))), F.lit(1).cast("long"), times)))
    # index ranges of bounded length, spread over tasks before generating rows
    nchunks = F.greatest(F.ceil(F.col("_total") / chunk), F.lit(1)).cast("long")
    x = x.select("*", F.explode(F.sequence(F.lit(0).cast("long"), nchunks - 1)).alias("_c"))
    x = spread(x.where(F.col("_total") > 0))
    lo = F.col("_c") * chunk
    hi = F.least(F.col("_total"), lo + chunk) - 1
    x = x.select("*", F.explode(F.sequence(lo, hi)).alias("idx"))
    pick = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(
        F.element_at("lists", i),
        (F.call_function("div", F.col("idx"), F.element_at("_w", i)) % F.element_at("_sz", i) + 1).cast("int")))
    return x.select(*id_cols, "idx", F.array_join(pick, " ").alias("text"))


def trace_origin(generated: DataFrame, keys=(), origin: str = "origin_pos") -> DataFrame:
    """EXP-6: provenance keyed by (keys, intent, text): one origin per
    generated text, the smallest origin position when several utterances
    generate the same text (originals point to themselves)."""
    k = list(keys)
    return generated.groupBy(*k, "intent", "text").agg(F.min(origin).alias(origin))


# --- EXP-3 ---------------------------------------------------------------------------------

def vector_synonyms(words: DataFrame, vectors: DataFrame, n: int = 10, word: str = "token",
                    exact: bool = True, probes: int = PROBES, index: VectorIndex | None = None) -> DataFrame:
    """EXP-3: for each query word its ``n`` nearest vocabulary words by
    cosine similarity (ties: the smaller word), the word itself excluded;
    out-of-vocabulary words map to themselves (rank 1, similarity null).
    Case-sensitive.

    The vocabulary is an inverted file (``vector_index``; pass ``index`` to
    use one again). With ``exact`` every list that can matter is visited,
    without it the ``probes`` nearest ones only."""
    index = index or VectorIndex(vectors)
    asked = words.select(F.col(word).alias("_q")).distinct()
    q = asked.join(index.members.select(F.col("_v").alias("_q"), "_vec"), "_q")
    near = index.nearest(q, n, probes, exact).withColumnRenamed("_q", word)
    oov = (asked.join(index.members.select(F.col("_v").alias("_q")), "_q", "left_anti")
           .select(F.col("_q").alias(word), F.col("_q").alias("synonym"), F.lit(None).cast("double").alias("sim"),
                   F.lit(1).alias("rank")))
    return near.select(word, "synonym", "sim", "rank").unionByName(oov)


# --- EXP-7 / EXP-8 / EXP-9 --------------------------------------------------------------------

def paraphrase_with_pairs(utts: DataFrame, pairs: DataFrame, id_cols, k: int = config.PARAPHRASES_PER_INPUT,
                          text: str = "text") -> DataFrame:
    """EXP-7, built-in pair-table model: every run of tokens of an utterance
    that equals a pair's ``input_text`` (runs of all the lengths that occur
    in the pair table are tried) is replaced by the pair's ``target_text``; per utterance the ``k`` longest matches (then
    earliest start, then target text) are kept. Output: id columns, ``k_i``
    (1..k), ``pred``."""
    lengths = F.coalesce(pairs.select(F.collect_set(F.size(F.split("input_text", " ")))).scalar(),
                         F.array().cast("array<int>"))
    toks = utts.select(*id_cols, tokens_space(F.col(text)).alias("_t"))
    grams = toks.select("*", F.posexplode("_t").alias("_s", "_x")).select(
        *id_cols, "_t", "_s", F.explode(lengths).alias("_n"))
    grams = grams.where(F.col("_s") + F.col("_n") <= F.size("_t")).withColumn(
        "_g", F.array_join(F.slice("_t", F.col("_s") + 1, F.col("_n")), " "))
    p = broadcast_if_small(pairs.select(F.col("input_text").alias("_g"), "target_text").distinct())
    m = grams.join(p, "_g")
    w = Window.partitionBy(*id_cols).orderBy(F.col("_n").desc(), F.col("_s"), F.col("target_text"))
    m = m.withColumn("k_i", F.row_number().over(w)).where(F.col("k_i") <= k)
    before = F.array_join(F.slice("_t", F.lit(1), F.col("_s")), " ")
    after = F.array_join(F.slice("_t", F.col("_s") + F.col("_n") + 1, F.size("_t")), " ")
    pred = F.concat_ws(" ", F.when(F.col("_s") > 0, before), F.col("target_text"),
                       F.when(F.col("_s") + F.col("_n") < F.size("_t"), after))
    return m.select(*id_cols, "k_i", pred.alias("pred"))


def paraphrase_with_model(utts: DataFrame, model_factory: Callable | JoinedModel, id_cols, text: str = "text",
                          batch_size: int = 64) -> DataFrame:
    """EXP-7, plug-in model: ``model_factory()`` is called once per Python
    worker and returns ``f(list[str]) -> list[list[str]]``; distinct inputs
    are sent in Arrow batches of ``batch_size``. A ``JoinedModel`` first attaches
    columns to the inputs, which its ``f`` takes behind the texts."""
    distinct, factory, more = utts.select(F.col(text).alias("_in")).distinct(), model_factory, ()
    if isinstance(model_factory, JoinedModel):
        distinct, factory, more = model_factory.inputs(distinct, "_in"), model_factory.model(), model_factory.columns

    def run(it):
        model = factory()
        for pdf in it:
            for i in range(0, len(pdf), batch_size):
                chunk, *rest = (list(pdf[c].iloc[i:i + batch_size]) for c in ("_in", *more))
                outs = model(chunk, *rest)
                rows = [(a, j + 1, p) for a, ps in zip(chunk, outs) for j, p in enumerate(ps)]
                yield pd.DataFrame(rows, columns=["_in", "k_i", "pred"])

    gen = distinct.mapInPandas(run, "_in string, k_i int, pred string")
    return utts.join(gen.withColumnRenamed("_in", text), text).select(*id_cols, "k_i", "pred")


def clean_paraphrases(df: DataFrame, id_cols, src: str = "text", pred: str = "pred") -> DataFrame:
    """EXP-8: per input distinct predictions (first-seen ``k_i``), drop the
    ones equal or near-equal to the input (``? . ,`` removed, lower case),
    then drop non-ASCII characters and trim."""
    d = df.groupBy(*id_cols, src, pred).agg(F.min("k_i").alias("k_i"))
    keep = (F.col(pred) != F.col(src)) & (norm_paraphrase(pred) != norm_paraphrase(src))
    return d.where(keep).withColumn(pred, ascii_fold(pred))


def assemble(originals: DataFrame, paraphrases: DataFrame, keys=()) -> DataFrame:
    """EXP-9: candidate set = originals ++ paraphrases (bag union); the
    synonym-only variants are paraphraser inputs, not candidates."""
    k = list(keys)
    cols = k + ["intent", "text", "origin_pos", "gen_step"]
    o = originals.select(*k, "intent", "text", F.col("pos").alias("origin_pos"), F.lit("original").alias("gen_step"))
    return o.unionByName(paraphrases.select(*cols))
