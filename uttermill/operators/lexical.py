"""Tokens, tags, lexicons and synonyms (EXP-1..4, DST-1, SRC-9).

A lexicon is a user table ``(word, upos, lemma)``; a synonym table is
``(word, synonym, rank)``; word vectors are ``(word, vec)``. The tagger,
lemmatiser and thesaurus of the original workflow are replaced by these
tables (joins), so no per-row library runs inside Spark tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import lemma_rule, tokens_space, unit
from ..session import broadcast_if_small, collect_if_small, materialize


def tokenize(df: DataFrame, id_cols, text: str = "text") -> DataFrame:
    """One row per (utterance, position): ``tok_pos`` (0-based), ``token``.
    Blank-separated; empty tokens of double blanks are kept so that joining
    the tokens back restores the text."""
    return df.select(*id_cols, F.posexplode(tokens_space(F.col(text))).alias("tok_pos", "token"))


def rule_lexicon(tokens: DataFrame, token: str = "token") -> DataFrame:
    """A lexicon over the distinct tokens with the rule lemmatiser; ``upos``
    is left null (tests build tags separately)."""
    return (tokens.select(F.col(token).alias("word")).distinct()
            .select("word", F.lit(None).cast("string").alias("upos"), lemma_rule("word").alias("lemma")))


def tag_tokens(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """EXP-1: attach ``upos`` and ``lemma`` from the lexicon (unknown word:
    no tag, lemma = the word)."""
    lx = broadcast_if_small(lexicon.select(F.col("word").alias("token"), "upos", "lemma"))
    return (tokens.join(lx, "token", "left")
            .withColumn("lemma", F.coalesce("lemma", "token")))


def mark_replaceable(tagged: DataFrame, id_cols, part_of_speech: str = "verb") -> DataFrame:
    """EXP-1: ``replaceable`` is true for a token string that is tagged with
    a chosen part of speech anywhere in the same utterance."""
    if part_of_speech not in config.POS_CHOICES:
        raise ValueError(f"part of speech must be one of {config.POS_CHOICES}, got {part_of_speech!r}")
    wanted = {"verb": ["VERB"], "noun": ["NOUN"], "verb_and_noun": ["VERB", "NOUN"]}[part_of_speech]
    hit = F.coalesce(F.col("upos").isin(wanted), F.lit(False))
    w = Window.partitionBy(*id_cols, "token")
    return tagged.withColumn("replaceable", F.max(hit).over(w))


def lemmatise(df: DataFrame, lexicon: DataFrame, id_cols, text: str = "text",
              out: str = "lemma") -> DataFrame:
    """DST-1: every token replaced by its lemma, joined by blanks; unknown
    words stay as they are (of several lemmas of a word the smallest counts).
    ``id_cols`` are unique.

    Only words that change are held: within the size check they are a broadcast
    dictionary and the texts stream past it; more of them meet the tokens in a
    join, and only the changed tokens are regrouped."""
    lemma = F.min(F.coalesce("lemma", "word")).alias("lemma")
    changed = lexicon.groupBy("word").agg(lemma).where(F.col("lemma") != F.col("word"))
    texts = df.select(*id_cols, F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    rows = collect_if_small(changed)
    if rows is None:
        return _lemmatise_joined(texts, changed, id_cols, out)
    shared = df.sparkSession.sparkContext.broadcast(dict(map(tuple, rows)))

    def run(batches):
        for b in batches:
            known = shared.value
            done = [" ".join([known.get(t, t) for t in x.split(" ")]) for x in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(done, pa.string())], [*b.schema.names[:-1], out])

    return texts.mapInArrow(run, _lemma_schema(texts, out))


def _lemma_schema(texts: DataFrame, out: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields
                      if f.name not in ("_t", "_rid", "_at", "_new")] + [f"`{out}` string"])


def _lemmatise_joined(texts: DataFrame, changed: DataFrame, id_cols, out: str) -> DataFrame:
    own = materialize(texts.withColumn("_rid", F.monotonically_increasing_id()))
    tokens = own.select("_rid", F.posexplode(tokens_space("_t")).alias("_i", "word"))
    hit = tokens.join(changed.hint("shuffle_hash"), "word").groupBy("_rid").agg(
        F.collect_list(F.struct("_i", "lemma")).alias("_l"))
    both = own.join(hit, "_rid", "left").select(*id_cols, "_t", F.col("_l._i").alias("_at"), F.col("_l.lemma").alias("_new"))

    def run(batches):
        for b in batches:
            done = []
            for x, at, new in zip(*[b.column(c).to_pylist() for c in ("_t", "_at", "_new")]):
                said = x.split(" ")
                for i, lemma in zip(at or (), new or ()):
                    said[i] = lemma
                done.append(" ".join(said))
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(done, pa.string())], [*b.schema.names[:-3], out])

    return both.mapInArrow(run, _lemma_schema(both, out))


def build_synonyms(df: DataFrame) -> DataFrame:
    """SRC-9: (word, synonym, rank) with the first rank per pair."""
    return df.groupBy("word", "synonym").agg(F.min("rank").alias("rank"))


def build_vectors(df: DataFrame, word: str = "word", vec: str = "vec") -> DataFrame:
    """SRC-9: one vector per word (the first by input order is not defined
    in a distributed table, so the smallest vector is kept), scaled to unit
    length."""
    one = df.groupBy(F.col(word).alias("word")).agg(F.min(vec).alias("vec"))
    return one.select("word", unit("vec").alias("vec"))


def lexical_synonyms(words: DataFrame, synonyms: DataFrame, word: str = "token") -> DataFrame:
    """EXP-2: all synonyms of each word in table order, first-seen distinct,
    names containing ``_`` dropped. Output: words' columns + ``synonym``,
    ``rank`` (null synonym when the table has none)."""
    s = (build_synonyms(synonyms).where(~F.col("synonym").contains("_"))
         .withColumnRenamed("word", word))
    return words.join(broadcast_if_small(s), word, "left")


def candidate_synonyms(tokens: DataFrame, source: str, synonyms: DataFrame | None = None,
                       vectors: DataFrame | None = None, n: int = 10,
                       word: str = "token") -> DataFrame:
    """EXP-4: synonym list per token with the guard rules: question words
    keep themselves, an empty list becomes the word itself, an unknown
    source is an error. Output: tokens' columns + ``syns`` (array, in
    rank order)."""
    if source not in config.SYNONYM_SOURCES:
        raise ValueError(f"synonym source must be one of {config.SYNONYM_SOURCES}, got {source!r}")
    words = tokens.select(word).distinct()
    if source == "wordnet":
        pairs = lexical_synonyms(words, synonyms, word).where(F.col("synonym").isNotNull())
    else:
        from .expand import vector_synonyms
        pairs = vector_synonyms(words, vectors, n, word=word)
        pairs = pairs.where(~F.col("synonym").contains("_"))
    lists = (pairs.groupBy(word)
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "synonym"))),
                              lambda x: x["synonym"]).alias("_s")))
    is_wh = F.lower(F.col(word)).isin(list(config.WH_WORDS))
    out = tokens.join(broadcast_if_small(lists), word, "left")
    syns = (F.when(is_wh, F.array(F.col(word)))
            .when(F.coalesce(F.size("_s"), F.lit(0)) <= 0, F.array(F.col(word)))
            .otherwise(F.col("_s")))
    return out.withColumn("syns", syns).drop("_s")
