"""EXP-7: a paraphrase model from the pair table, run by the plug-in host.

The phrase table has, for every input text of the pairs, its target texts with
their share among that input's pairs. An utterance is a lattice over its
tokens: every token may be copied, and every run of tokens that is an input
text may become one of its targets. A path weighs the sum of the logarithms of
its shares, with ``COPY`` for each copied token; the K heaviest texts are the
predictions (the utterance itself included, equal weights by text).

The decoder keeps the K best distinct texts at each place. A longer text comes
from a place's text by the same addition whatever the text, so these are the K
best of all paths, not an approximation.

A phrase table within the size check is broadcast. A larger one is joined with
the token runs of the utterances, and every utterance comes with its own part
of it.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import nsmallest
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import tokens_space
from ..session import broadcast_if_small, collect_if_small, materialize

#: Share of a copied token.
COPY = 0.5


def phrase_table(pairs: DataFrame) -> DataFrame:
    """input_text, target_text, share: of the pairs with that input, those with that target."""
    n = pairs.groupBy("input_text", "target_text").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.groupBy("input_text").agg(F.count(F.lit(1)).alias("total"))
    return n.join(total, "input_text").select("input_text", "target_text", (F.col("n") / F.col("total")).alias("share"))


class Decoder:
    """``phrases``: tokens of an input text -> [(weight, target text)]."""

    def __init__(self, phrases: dict, k: int):
        self.phrases, self.k = phrases, k
        self.longest = max(map(len, phrases), default=0)

    def best(self, text: str) -> list[tuple[float, str]]:
        """(weight, text) of the K best, heaviest first."""
        tokens = text.split(" ")
        states: list[dict] = [{} for _ in range(len(tokens) + 1)]
        states[0] = {None: 0.0}
        for i in range(len(tokens)):
            kept = self._top(states[i])
            for j in range(i + 1, min(len(tokens), i + max(1, self.longest)) + 1):
                edges = list(self.phrases.get(tuple(tokens[i:j]), ()))
                if j == i + 1:
                    edges.append((log(COPY), tokens[i]))
                for done, weight in kept:
                    for more, target in edges:
                        whole = target if done is None else f"{done} {target}"
                        if weight + more > states[j].get(whole, float("-inf")):
                            states[j][whole] = weight + more
        return [(w, t) for t, w in self._top(states[-1])]

    def _top(self, state: dict) -> list[tuple]:
        return nsmallest(self.k, state.items(), key=lambda x: (-round(x[1], 9), x[0] or ""))

    def __call__(self, texts: list[str]) -> list[list[str]]:
        return [[t for _, t in self.best(x)] for x in texts]


class JoinedModel:
    """A model whose utterances come with their phrases: ``inputs`` attaches
    them, and ``model()`` takes the texts and the attached columns."""

    columns = ("sources", "shares", "targets")

    def __init__(self, table: DataFrame, k: int):
        self.table, self.k = table, k

    def inputs(self, texts: DataFrame, text: str) -> DataFrame:
        """``texts`` (distinct) with arrays: the input texts that are token runs
        of the text, and their shares and targets. Of an input text the K best
        targets suffice: behind any start they give K heavier texts than the
        others."""
        lengths = F.coalesce(self.table.select(F.collect_set(F.size(tokens_space("input_text")))).scalar(),
                             F.array().cast("array<int>"))
        runs = texts.select(text, tokens_space(text).alias("_t"))
        runs = runs.select("*", F.posexplode("_t").alias("_s", "_x")).select(text, "_t", "_s", F.explode(lengths).alias("_n"))
        runs = runs.where(F.col("_s") + F.col("_n") <= F.size("_t")).select(
            text, F.array_join(F.slice("_t", F.col("_s") + 1, F.col("_n")), " ").alias("input_text")).distinct()
        runs = materialize(runs)
        said = self.table.join(broadcast_if_small(runs.select("input_text").distinct()), "input_text", "left_semi")
        w = Window.partitionBy("input_text").orderBy(F.col("share").desc(), "target_text")
        best = said.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= self.k)
        own = runs.join(best, "input_text").groupBy(text).agg(F.collect_list(F.struct(
            "input_text", "share", "target_text")).alias("_p"))
        whole = texts.join(own, text, "left")
        return whole.select(text, *[F.coalesce(F.col(f"_p.{c}"), F.array().cast(f"array<{kind}>")).alias(name)
                                    for name, c, kind in zip(self.columns, ("input_text", "share", "target_text"),
                                                             ("string", "double", "string"))])

    def model(self) -> Callable:
        k = self.k

        def predict(texts, sources, shares, targets):
            out = []
            for text, *own in zip(texts, sources, shares, targets):
                phrases: dict = {}
                for source, share, target in zip(*own):
                    phrases.setdefault(tuple(source.split(" ")), []).append((log(share), target))
                out.extend(Decoder(phrases, k)([text]))
            return out

        return lambda: predict


def model_factory(pairs: DataFrame, k: int = config.PARAPHRASES_PER_INPUT) -> Callable | JoinedModel:
    """What ``expand.paraphrase_with_model`` takes. The phrase table is
    broadcast behind a check of its rows and bytes; a larger one is joined."""
    table = phrase_table(pairs)
    rows = collect_if_small(table)
    if rows is None:
        return JoinedModel(materialize(table), k)
    phrases: dict = {}
    for source, target, share in rows:
        phrases.setdefault(tuple(source.split(" ")), []).append((log(share), target))
    shared = pairs.sparkSession.sparkContext.broadcast(phrases)
    return lambda: Decoder(shared.value, k)
