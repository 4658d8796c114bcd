"""Stand-in corpora derived from the test tables (whole tables, whole
texts). Each has an SQL twin in ``oracle.py``.

- L: every non-empty line of ``documents.text``, non-ASCII characters
  removed and blanks trimmed, distinct per (intent = lang, text); ``pos`` =
  doc_id * 1e6 + line number of the first occurrence.
- P: ``part``; intent = p_type, text = p_name, pos = smallest p_partkey.
- E: ``embeddings``; intent = label, text = vec_id as string.
- V: ``events`` as an evaluation log (see ``events_log``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ascii_fold

LINE_FACTOR = 1_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    x = lines.select(F.col("lang").alias("intent"), ascii_fold("line").alias("text"),
                     (F.col("doc_id") * LINE_FACTOR + F.col("ln")).alias("pos"))
    return x.where(F.col("text") != "").groupBy("intent", "text").agg(F.min("pos").alias("pos"))


def corpus_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return (p.groupBy(F.col("p_type").alias("intent"), F.col("p_name").alias("text"))
            .agg(F.min("p_partkey").alias("pos")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("text"),
                    F.col("label").cast("string").alias("intent"), F.col("embedding").alias("vec"))


def events_log(spark: SparkSession, d: str) -> DataFrame:
    """V: events read as an evaluation log of the experiment grid.

    true intent = event_type; predicted intent = the event type whose rank
    in the sorted type list equals k mod (number of types), k from
    ``props``; confidence = value / (value + 10); train_n = 1, 3 or 5 by
    user_id mod 3; run = day of month mod 10 + 1; loop = event_id mod 3 + 1.
    """
    ev = table(spark, d, "events")
    # scalar subquery: the sorted list of distinct types (one value)
    types = ev.select(F.array_sort(F.collect_set("event_type"))).scalar()
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.withColumn("types", types).select(
        F.element_at(F.array(F.lit(1), F.lit(3), F.lit(5)), (F.col("user_id") % 3 + 1).cast("int")).alias("train_n"),
        (F.dayofmonth("ts") % 10 + 1).alias("run"),
        (F.col("event_id") % 3 + 1).alias("loop"),
        F.col("event_id").cast("string").alias("text"),
        F.col("event_type").alias("intent"),
        F.element_at("types", (k % F.size("types") + 1).cast("int")).alias("pred"),
        (F.col("value") / (F.col("value") + 10)).alias("conf"),
    )


# --- P as a tagged corpus (EXP tests) ------------------------------------------------------

def part_tokens(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.lexical import tokenize
    return tokenize(corpus_parts(spark, d), ["intent", "pos"])


def part_lexicon(tokens: DataFrame) -> DataFrame:
    """Lexicon from P: first words tagged VERB, second words NOUN (NOUN wins
    for a word seen in both places); lemma by the rule lemmatiser."""
    from ..functions import lemma_rule
    tag = F.when(F.col("tok_pos") == 0, "VERB").otherwise("NOUN")
    return (tokens.groupBy(F.col("token").alias("word")).agg(F.min(tag).alias("upos"))
            .withColumn("lemma", lemma_rule("word")))


def part_synonyms(tokens: DataFrame) -> DataFrame:
    """Synonym table from P: words at the same position in names of the
    same type are synonyms (rank 1; lists then sort by the synonym)."""
    g = (tokens.select("intent", "tok_pos", "token").distinct()
         .groupBy("intent", "tok_pos").agg(F.collect_set("token").alias("ws")))
    return (g.select(F.explode("ws").alias("word"), "ws")
            .select("word", F.explode("ws").alias("synonym"), F.lit(1).alias("rank")))


def pair_sources(spark: SparkSession, d: str) -> list[DataFrame]:
    """Pair sources: conversation user turns -> the next assistant turn,
    and P names -> the next name of the same type in md5 order."""
    from ..functions import md5_order
    from ..operators.pairs import select_pairs
    from pyspark.sql import Window
    cv = table(spark, d, "conversations")
    u = cv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("a"))
    a = cv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("b"))
    conv = select_pairs(u.join(a, ["conv_id", "turn"]), "a", "b", source="conversations")
    P = corpus_parts(spark, d)
    w = Window.partitionBy("intent").orderBy(md5_order(7, "text"), "text")
    nxt = P.withColumn("b", F.lead("text").over(w)).where(F.col("b").isNotNull())
    return [conv, select_pairs(nxt, "text", "b", source="part")]
