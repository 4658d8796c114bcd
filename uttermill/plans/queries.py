"""Registered queries: one per operator (or operator group) of the
inventory. Each takes (spark, sf_dir) and returns a DataFrame whose columns
and types equal the DuckDB oracle's (integers as BIGINT, floats rounded to
6 digits)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import ascii_fold
from ..session import materialize
from ..operators import corpora, distance, lexical
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def std(df: DataFrame) -> DataFrame:
    """Integers -> BIGINT, floating point -> DOUBLE rounded to 6 digits."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- shared plan pieces -----------------------------------------------------

def _fewshot_l(spark, d, seed=config.SEED):
    return corpora.fewshot_splits(fx.corpus_lines(spark, d), seed=seed)


def _candidates_l(spark, d):
    """Every split's candidates: L minus the split's originals. L is written
    once: the originals and the candidates read it."""
    L = materialize(fx.corpus_lines(spark, d))
    fs = corpora.fewshot_splits(L)
    return corpora.subtract_corpus(fs, corpora.for_each_run(L), keys=["train_n", "run"]), fs


def _distances_l(spark, d):
    L = materialize(fx.corpus_lines(spark, d))
    fs = corpora.fewshot_splits(L)
    return distance.min_distance_fewshot(L, fs, config.TRAIN_SIZES)


# --- SET ----------------------------------------------------------------------

@register("fewshot")
def q_fewshot(spark, d):
    return std(_fewshot_l(spark, d))


@register("subtract")
def q_subtract(spark, d):
    c, _ = _candidates_l(spark, d)
    return std(c.select("train_n", "run", "intent", "pos"))


@register("merge")
def q_merge(spark, d):
    a = _fewshot_l(spark, d)
    b = _fewshot_l(spark, d, seed=7)
    return std(corpora.merge_corpora(a, b, keys=["train_n", "run"]))


@register("limit_n")
def q_limit_n(spark, d):
    L = materialize(fx.corpus_lines(spark, d))
    fs = corpora.fewshot_splits(L)
    r = corpora.limit_per_intent(fs, corpora.for_each_run(L), n=config.LIMIT_PER_INTENT,
                                 keys=["train_n", "run"])
    return std(r.select("train_n", "run", "intent", "text", "pos", "pick"))


@register("one_per_intent")
def q_one_per_intent(spark, d):
    c, _ = _candidates_l(spark, d)
    r = corpora.one_per_intent(c, seed="one", keys=["train_n", "run"])
    return std(r.select("train_n", "run", "intent", "text", "pos"))


# --- DST ----------------------------------------------------------------------

@register("min_distance")
def q_min_distance(spark, d):
    return std(_distances_l(spark, d).select("train_n", "run", "intent", "pos", "dist"))


@register("farthest")
def q_farthest(spark, d):
    """Flagship: per split and intent the K lines farthest (edit distance)
    from the few-shot originals."""
    L = materialize(fx.corpus_lines(spark, d))
    r = distance.farthest_from_fewshot(L, corpora.fewshot_splits(L), config.TRAIN_SIZES,
                                       config.KEEP_BY_DISTANCE)
    return std(r.select("train_n", "run", "intent", "text", "dist", "rk"))


@register("lemmatise")
def q_lemmatise(spark, d):
    L = materialize(fx.corpus_lines(spark, d))
    lex = lexical.rule_lexicon(lexical.tokenize(L, ["intent", "pos"]))
    return std(lexical.lemmatise(L, lex, ["intent", "pos"]))


@register("pair_distance")
def q_pair_distance(spark, d):
    cv = fx.table(spark, d, "conversations").select("conv_id", "turn", "role", ascii_fold("text").alias("t"))
    u = cv.where(F.col("role") == "user").select("conv_id", "turn", F.col("t").alias("a"))
    a = cv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("t").alias("b"))
    j = distance.pair_distance(u.join(a, ["conv_id", "turn"]), "a", "b")
    return std(j.select("conv_id", "turn", "dist"))


@register("jaccard")
def q_jaccard(spark, d):
    c, fs = _candidates_l(spark, d)
    r = distance.jaccard_pairs(c, fs, keys=["train_n", "run"], min_sim=0.25)
    return std(r.select("train_n", "run", "intent", "pos", "orig_pos", "sim"))


# --- predictions: nearest centroid on E (N) -------------------------------------

KEYS = ["train_n", "run"]


def predictions_n(spark, d):
    """N: few-shot centroids per split, every other vector scored."""
    from ..operators import triage
    E = fx.vectors(spark, d)
    fs = corpora.fewshot_splits(E.select("intent", "text", "pos"))
    base = fs.join(E.select("pos", "vec"), "pos")
    model = triage.centroid_model(base, keys=KEYS)
    cands = corpora.subtract_corpus(fs, corpora.for_each_run(E), keys=KEYS)
    return triage.score_centroid(model, cands, keys=KEYS, scale=20.0)


@register("centroid_predict")
def q_centroid_predict(spark, d):
    return std(predictions_n(spark, d).select(*KEYS, "text", "intent", "pred", "conf"))


@register("uncertain")
def q_uncertain(spark, d):
    from ..operators import triage
    r = triage.uncertain(predictions_n(spark, d), config.THRESHOLD)
    return std(r.select(*KEYS, "text", "intent", "pred", "conf", "is_error"))


def _report_n(spark, d):
    from ..operators import evaluate
    return evaluate.class_report(predictions_n(spark, d), keys=KEYS)


@register("class_report")
def q_class_report(spark, d):
    return std(_report_n(spark, d))


@register("confused_top3")
def q_confused(spark, d):
    from ..operators import evaluate
    r = evaluate.confused_with(predictions_n(spark, d), 3, keys=KEYS)
    return std(r.select(*KEYS, "intent", "confused", "n", "rk"))


@register("totals")
def q_totals(spark, d):
    from ..operators import evaluate
    return std(evaluate.report_totals(_report_n(spark, d), keys=KEYS))


@register("run_listing")
def q_run_listing(spark, d):
    from ..operators import evaluate
    grid = corpora.experiment_grid(spark, config.TRAIN_SIZES, config.RUNS + 1)
    tot = evaluate.report_totals(_report_n(spark, d), keys=KEYS)
    return std(evaluate.run_listing(grid, tot, keys=KEYS))


# --- evaluation log V -------------------------------------------------------------

VKEYS = ["train_n", "run", "loop"]


def _v_report(spark, d):
    from ..operators import evaluate
    return evaluate.class_report(fx.events_log(spark, d), keys=VKEYS)


@register("v_report")
def q_v_report(spark, d):
    return std(_v_report(spark, d))


def _run_summary(spark, d):
    from ..operators import evaluate
    tot = evaluate.report_totals(_v_report(spark, d), keys=VKEYS)
    return evaluate.run_summary(tot, fx.events_log(spark, d), keys=KEYS)


@register("run_summary")
def q_run_summary(spark, d):
    return std(_run_summary(spark, d))


@register("size_summary")
def q_size_summary(spark, d):
    from ..operators import evaluate
    return std(evaluate.size_summary(_run_summary(spark, d)))


@register("confidence_lists")
def q_confidence_lists(spark, d):
    from ..operators import evaluate
    return std(evaluate.confidences(fx.events_log(spark, d), keys=KEYS))


def _intent_summary(spark, d):
    from ..operators import evaluate
    return evaluate.intent_summary(_v_report(spark, d))


@register("intent_summary")
def q_intent_summary(spark, d):
    return std(_intent_summary(spark, d))


@register("new_counts")
def q_new_counts(spark, d):
    from ..operators import evaluate, triage
    log = fx.events_log(spark, d)
    kept = triage.uncertain(log, config.THRESHOLD)
    return std(evaluate.new_example_counts(kept, _v_report(spark, d)))


@register("pivot_intents")
def q_pivot_intents(spark, d):
    from ..operators import evaluate
    return std(evaluate.pivot_intents(_intent_summary(spark, d)))


# --- naive Bayes on L, triage ----------------------------------------------------------

@register("nb_predict")
def q_nb_predict(spark, d):
    from ..operators import triage
    cands, fs = _candidates_l(spark, d)
    p = triage.score_nb(triage.train_nb(fs, keys=KEYS), cands, ids=["pos"], keep=[*KEYS, "intent", "pos"])
    return std(p.select(*KEYS, "intent", "pos", "pred", "conf"))


@register("softmax_predict")
def q_softmax_predict(spark, d):
    """TRI-1 with character n-grams: the models of all splits of P score the other names."""
    from ..operators import softmax
    P = fx.corpus_parts(spark, d)
    fs = corpora.fewshot_splits(P)
    weights = softmax.train_softmax(fs, KEYS)
    cands = corpora.subtract_corpus(fs, corpora.for_each_run(P), keys=KEYS)
    return std(softmax.score_softmax(weights, cands, KEYS).select(*KEYS, "intent", "pos", "pred", "conf"))


def _triage_l(spark, d):
    from ..operators import triage
    L = materialize(fx.corpus_lines(spark, d))
    fs = corpora.fewshot_splits(L)
    model = triage.train_nb(fs, keys=KEYS)
    near = distance.min_distance_fewshot(L, fs, config.TRAIN_SIZES, with_nearest=True)
    scored = triage.score_nb(model, near, ids=["pos"])
    return triage.triage_table(scored, config.THRESHOLD), fs


@register("triage")
def q_triage(spark, d):
    t, _ = _triage_l(spark, d)
    return std(t.select(*KEYS, "intent", "pos", "origin_pos", "dist", "pred", "conf", "category"))


@register("best_per_origin")
def q_best_per_origin(spark, d):
    from ..operators import triage
    t, fs = _triage_l(spark, d)
    r = triage.best_per_origin(t, fs, keys=KEYS)
    return std(r.select(*KEYS, "intent", "text", "pos", "picked"))


@register("avg_growth")
def q_avg_growth(spark, d):
    from ..operators import evaluate
    L = materialize(fx.corpus_lines(spark, d))
    fs = corpora.fewshot_splits(L)
    far = distance.farthest_from_fewshot(L, fs, config.TRAIN_SIZES, config.KEEP_BY_DISTANCE)
    grown = corpora.merge_corpora(fs, far, keys=KEYS)
    n_int = L.select(F.countDistinct("intent")).scalar()
    base = (spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in config.TRAIN_SIZES])).alias("train_n"))
            .withColumn("n", F.col("train_n") * n_int))
    return std(evaluate.avg_growth(grown, base, keys=KEYS))


# --- corpus files: SNK-1 -> SRC-1/2/3 round trip ------------------------------------------

def _roundtrip(spark, df, name, keys=()):
    from ..session import scratch_path
    from ..sinks.corpus import write_corpus
    path = scratch_path(spark, name)
    write_corpus(df, path, keys=keys)
    return path


@register("corpus_scan")
def q_corpus_scan(spark, d):
    """L written as a corpus document set, read back and cleaned (SRC-1)."""
    from ..sources.corpus import read_corpus
    path = _roundtrip(spark, fx.corpus_lines(spark, d), "corpus")
    return std(read_corpus(spark, path).select("intent", "text"))


@register("raw_scan")
def q_raw_scan(spark, d):
    from ..sources.corpus import read_raw
    path = _roundtrip(spark, fx.corpus_lines(spark, d), "corpus-raw")
    return std(read_raw(spark, path).select("intent", "raw"))


def _annotated_parts(spark, d):
    P = fx.corpus_parts(spark, d)
    return P.withColumn("text", F.regexp_replace("text", r" (\S+)$", " [$1](item)"))


@register("entity_extract")
def q_entity_extract(spark, d):
    from ..sources.corpus import extract_entities, read_raw
    path = _roundtrip(spark, _annotated_parts(spark, d), "corpus-ent")
    return std(extract_entities(read_raw(spark, path)).select("intent", "entity", "surface", "etype", "ord"))


# --- evaluation outputs: SNK-2/3 and writers -> SRC-5..8 round trips ------------------------

@register("prediction_scan")
def q_prediction_scan(spark, d):
    from ..session import scratch_path
    from ..sinks.results import write_predictions
    from ..sources.logs import read_predictions
    root = scratch_path(spark, "predictions")
    write_predictions(predictions_n(spark, d), root, keys=KEYS)
    r = read_predictions(spark, root)
    return std(r.select(*KEYS, "text", "intent", "pred", "conf", "outcome"))


def _reports_roundtrip(spark, d):
    from ..operators import evaluate
    from ..session import scratch_path
    from ..sinks.results import write_reports
    from ..sources.logs import read_reports
    pred = predictions_n(spark, d)
    rep = evaluate.class_report(pred, keys=KEYS)
    tot = evaluate.report_totals(rep, keys=KEYS)
    conf = evaluate.confused_with(pred, 3, keys=KEYS)
    root = scratch_path(spark, "reports")
    write_reports(rep, tot, conf, root, keys=KEYS)
    return read_reports(spark, root)


@register("report_scan")
def q_report_scan(spark, d):
    per, _ = _reports_roundtrip(spark, d)
    conf = F.when(F.size("confused_with") > 0, F.array_join(F.array_sort(F.map_keys("confused_with")), ","))
    return std(per.select(*KEYS, "intent", "precision", "recall", "f1", "support", conf.alias("confused")))


@register("report_totals_scan")
def q_report_totals_scan(spark, d):
    _, tot = _reports_roundtrip(spark, d)
    return std(tot.select(*KEYS, "accuracy", "macro_f1", "weighted_precision", "weighted_recall",
                          "weighted_f1", "support"))


@register("filter_scan")
def q_filter_scan(spark, d):
    from ..operators import triage
    from ..session import scratch_path
    from ..sinks.results import write_filter_results
    from ..sources.logs import read_filter_results
    root = scratch_path(spark, "filters")
    write_filter_results(triage.uncertain(predictions_n(spark, d)), root, keys=KEYS, chunk=100)
    return std(read_filter_results(spark, root).select(*KEYS, "intent", "text"))


@register("grid_scan")
def q_grid_scan(spark, d):
    """SRC-7 on reference-style result paths built from every row of V."""
    from ..sources.logs import with_grid_keys
    v = fx.events_log(spark, d)
    path = F.concat(F.lit("/results/repository/augment_and_human_train_1-3-5_cs_threshold_0.7_2021-08-05_15-12"),
                    F.lit("/train_"), F.col("train_n"), F.lit("/run_"), F.col("run"),
                    F.lit("/results/loop_"), F.col("loop"), F.lit("/intent_report.json"))
    g = with_grid_keys(v.select(path.alias("_file")))
    return std(g.groupBy("dataset", "exp_type", *VKEYS).agg(F.count(F.lit(1)).alias("n")))


@register("results_csv")
def q_results_csv(spark, d):
    """SNK-3: the class report of N as CSV with header, read back."""
    from ..session import scratch_path
    from ..sinks.results import write_results
    path = scratch_path(spark, "csv")
    write_results(_report_n(spark, d), path)
    schema = "train_n int, run int, intent string, precision double, recall double, f1 double, support long, tp long"
    return std(spark.read.schema(schema).option("header", True).csv(path))


# --- EXP on P: tags, synonyms, combinations ----------------------------------------------------

def _tagged_parts(spark, d, mode="verb_and_noun"):
    tok = fx.part_tokens(spark, d)
    lex = fx.part_lexicon(tok)
    return lexical.mark_replaceable(lexical.tag_tokens(tok, lex), ["intent", "pos"], mode), tok


@register("token_tags")
def q_token_tags(spark, d):
    tok = fx.part_tokens(spark, d)
    t = lexical.tag_tokens(tok, fx.part_lexicon(tok))
    return std(t.select("intent", "pos", "tok_pos", "token", "upos", "lemma"))


@register("replaceable")
def q_replaceable(spark, d):
    out = None
    for mode in config.POS_CHOICES:
        t, _ = _tagged_parts(spark, d, mode)
        t = t.select(F.lit(mode).alias("mode"), "intent", "pos", "tok_pos", "token", "replaceable")
        out = t if out is None else out.unionByName(t)
    return std(out)


@register("synonym_tables")
def q_synonym_tables(spark, d):
    return std(lexical.build_synonyms(fx.part_synonyms(fx.part_tokens(spark, d))))


@register("vector_table")
def q_vector_table(spark, d):
    from ..functions import l2norm
    v = lexical.build_vectors(fx.vectors(spark, d).select(F.col("text").alias("word"), "vec"))
    return std(v.select("word", F.size("vec").alias("dim"), F.element_at("vec", 1).alias("v1"),
                        (l2norm("vec") * l2norm("vec")).alias("norm2")))


@register("lexical_synonyms")
def q_lexical_synonyms(spark, d):
    tok = fx.part_tokens(spark, d)
    words = tok.select("token").distinct()
    return std(lexical.lexical_synonyms(words, fx.part_synonyms(tok)).select("token", "synonym", "rank"))


@register("synonym_guard")
def q_synonym_guard(spark, d):
    tok = fx.part_tokens(spark, d)
    r = lexical.candidate_synonyms(tok.select("token").distinct(), "wordnet", synonyms=fx.part_synonyms(tok))
    return std(r.select("token", F.array_join("syns", ",").alias("syns")))


@register("vector_synonyms")
def q_vector_synonyms(spark, d):
    from ..operators.expand import vector_synonyms
    E = fx.vectors(spark, d)
    r = vector_synonyms(E.select(F.col("text").alias("token")), E.select(F.col("text").alias("word"), "vec"), n=3)
    return std(r.select("token", "synonym", "rank", "sim"))


@register("vector_recall")
def q_vector_recall(spark, d):
    """EXP-3 without the exact step: whether the nearest lists alone give at
    least nine tenths of all neighbours."""
    from ..operators.vector_index import VectorIndex, recall
    E = fx.vectors(spark, d)
    index = VectorIndex(E.select(F.col("text").alias("word"), "vec"))
    words = index.members.select(F.col("_v").alias("_q"), "_vec")
    share = recall(index.nearest(words, 3, exact=False), index.nearest(words, 3))
    return spark.range(1).select(F.lit(share >= 0.9).alias("enough"), F.lit(index.members.count()).alias("words"))


def _combinations(spark, d):
    from ..operators.expand import expand_combinations, synonym_lists
    t, tok = _tagged_parts(spark, d)
    syn = lexical.candidate_synonyms(t, "wordnet", synonyms=fx.part_synonyms(tok))
    return expand_combinations(synonym_lists(syn, ["intent", "pos"]), ["intent", "pos"])


@register("combinations")
def q_combinations(spark, d):
    return std(_combinations(spark, d).select("intent", "pos", "idx", "text"))


@register("provenance")
def q_provenance(spark, d):
    from ..operators.expand import trace_origin
    gen = _combinations(spark, d).select("intent", "text", F.col("pos").alias("origin_pos"))
    orig = fx.corpus_parts(spark, d).select("intent", "text", F.col("pos").alias("origin_pos"))
    return std(trace_origin(orig.unionByName(gen)))


# --- pairs, paraphrases ---------------------------------------------------------------------------

def _pairs(spark, d):
    from ..operators import pairs
    return pairs.build_pairs(fx.pair_sources(spark, d))


@register("pairs_build")
def q_pairs_build(spark, d):
    return std(_pairs(spark, d))


@register("pairs_clean")
def q_pairs_clean(spark, d):
    from ..operators import pairs
    return std(pairs.clean_pairs(_pairs(spark, d)))


@register("pairs_split")
def q_pairs_split(spark, d):
    from ..operators import pairs
    return std(pairs.split_pairs(pairs.clean_pairs(_pairs(spark, d))).select(
        "source", "input_text", "target_text", "split"))


def _paraphrases_p(spark, d):
    from ..operators import pairs
    from ..operators.expand import paraphrase_with_pairs
    return paraphrase_with_pairs(fx.corpus_parts(spark, d), pairs.clean_pairs(_pairs(spark, d)),
                                 ["intent", "pos"], k=config.PARAPHRASES_PER_INPUT)


@register("paraphrase_pairs")
def q_paraphrase_pairs(spark, d):
    return std(_paraphrases_p(spark, d).select("intent", "pos", "k_i", "pred"))


@register("paraphrase_clean")
def q_paraphrase_clean(spark, d):
    from ..operators.expand import clean_paraphrases
    cv = fx.table(spark, d, "conversations")
    u = cv.where(F.col("role") == "user").select("conv_id", "turn", "text")
    a = cv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("reply"))
    j = u.join(a, ["conv_id", "turn"])
    preds = j.select("conv_id", "turn", "text", F.posexplode(F.array(
        "reply", F.lower(F.translate("text", "?.,", "")), "text")).alias("k_i", "pred"))
    r = clean_paraphrases(preds.withColumn("k_i", F.col("k_i") + 1), ["conv_id", "turn"])
    return std(r.select("conv_id", "turn", "k_i", "pred"))


@register("assemble")
def q_assemble(spark, d):
    from ..operators.expand import assemble, clean_paraphrases
    P = fx.corpus_parts(spark, d)
    para = clean_paraphrases(_paraphrases_p(spark, d).join(P, ["intent", "pos"]), ["intent", "pos"])
    para = para.select("intent", F.col("pred").alias("text"), F.col("pos").alias("origin_pos"),
                       F.lit("paraphrase").alias("gen_step"))
    return std(assemble(P, para))


# --- entities ---------------------------------------------------------------------------------------

def _part_entities(spark, d):
    P = fx.corpus_parts(spark, d)
    w1 = F.split("text", " ").getItem(0)
    w2 = F.split("text", " ").getItem(1)
    kinds = F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("["), w1, F.lit("/"), w2, F.lit("](item)")).alias("e")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("["), F.initcap(w1), F.initcap(w2), F.lit("](Thing)")).alias("e")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("["), w2, F.lit(".java](file)")).alias("e")))
    e = P.select("intent", "pos", F.explode(kinds).alias("x"))
    return e.groupBy("intent", F.col("x.e").alias("entity")).agg(
        F.min(F.col("pos") * 10 + F.col("x.k")).alias("ord"))


@register("entity_variants")
def q_entity_variants(spark, d):
    from ..operators.entities import expand_entities
    return std(expand_entities(_part_entities(spark, d)).select("intent", "ord", "vord", "variant"))


def _keywords(L):
    """Entities per intent: its 5 most frequent words of at least 5 letters, typed 'kw'."""
    from pyspark.sql import Window
    from ..functions import tokens_lower
    words = (L.select("intent", F.explode(tokens_lower("text")).alias("w")).where(F.length("w") >= 5)
             .groupBy("intent", "w").agg(F.count(F.lit(1)).alias("c")))
    top = words.withColumn("ord", F.row_number().over(
        Window.partitionBy("intent").orderBy(F.col("c").desc(), "w"))).where(F.col("ord") <= 5)
    return top.select("intent", "ord", F.lit(0).alias("vord"),
                      F.concat(F.lit("["), "w", F.lit("](kw)")).alias("variant"))


@register("mentions")
def q_mentions(spark, d):
    """ENT-2 over every line of L: occurrences of each keyword."""
    from ..operators.entities import find_mentions
    L = fx.corpus_lines(spark, d)
    return std(find_mentions(L, _keywords(L)).select("intent", "pos", "surface", "etype", "n"))


@register("mention_spans")
def q_mention_spans(spark, d):
    """ENT-2 over every line of L: offsets of the keywords and of their first
    four letters (which overlap them), longest first."""
    from ..operators.entities import mention_spans
    L = materialize(fx.corpus_lines(spark, d))
    whole = materialize(_keywords(L))
    start = whole.select("intent", (F.col("ord") + 5).alias("ord"), "vord", F.concat(
        F.lit("["), F.substr("variant", F.lit(2), F.lit(4)), F.lit("](start)")).alias("variant"))
    r = mention_spans(L, whole.unionByName(start))
    return std(r.select("intent", "pos", "start", "stop", "mention", "surface", "etype"))


@register("annotate")
def q_annotate(spark, d):
    from ..operators.entities import annotate
    P = fx.corpus_parts(spark, d)
    w = F.split("text", " ")
    ents = P.select("intent", F.explode(F.array(
        F.struct(F.concat(F.lit("["), w.getItem(0), F.lit("](adj)")).alias("variant"), F.lit(0).alias("k")),
        F.struct(F.concat(F.lit("["), w.getItem(1), F.lit("](item)")).alias("variant"), F.lit(1).alias("k"))))
        .alias("x"), "pos")
    ents = ents.groupBy("intent", "x.variant").agg(F.min(F.col("pos") * 10 + F.col("x.k")).alias("ord")) \
        .withColumn("vord", F.lit(0))
    return std(annotate(P, ents).select("intent", "pos", "annotated"))


# --- experiment modes (RUN-2..7) on P ------------------------------------------------------------

def _mode_inputs(spark, d):
    from ..operators import pairs
    from .experiments import Resources
    P = fx.corpus_parts(spark, d)
    fs = corpora.fewshot_splits(P)
    tok = fx.part_tokens(spark, d)
    res = Resources(lexicon=fx.part_lexicon(tok), synonyms=fx.part_synonyms(tok),
                    pairs=pairs.clean_pairs(pairs.build_pairs(fx.pair_sources(spark, d))),
                    part_of_speech="verb")
    return fs, P, res


@register("filter_chain")
def q_filter_chain(spark, d):
    from .experiments import candidates, filter_corpus
    fs, _, res = _mode_inputs(spark, d)
    r = filter_corpus(fs, candidates(fs, res), merge=True, lexicon=res.lexicon)
    return std(r.select(*KEYS, "intent", "text"))


@register("paraphrase_model")
def q_paraphrase_model(spark, d):
    """EXP-7 through the plug-in host: the phrase-lattice model on every name of P."""
    from ..operators import expand, pairs, phrase_model
    prc = pairs.clean_pairs(pairs.build_pairs(fx.pair_sources(spark, d)))
    P = fx.corpus_parts(spark, d)
    r = expand.paraphrase_with_model(P, phrase_model.model_factory(prc), ["intent", "pos"])
    return std(r.select("intent", "pos", "k_i", "pred"))


def _triage_lineage(spark, d):
    from .experiments import candidates, triage_by_origin
    fs, _, res = _mode_inputs(spark, d)
    return triage_by_origin(fs, candidates(fs, res), res.lexicon), fs


@register("triage_lineage")
def q_triage_lineage(spark, d):
    """TRI-3 on EXP-6's table: generated texts against the originals they come from."""
    t, _ = _triage_lineage(spark, d)
    return std(t.select(*KEYS, "intent", "text", "origin_pos", "dist", "pred", "conf", "category"))


@register("best_lineage")
def q_best_lineage(spark, d):
    """TRI-4 on that: one generated text per original."""
    from ..operators import triage
    t, fs = _triage_lineage(spark, d)
    return std(triage.best_per_origin(t, fs, keys=KEYS + ["intent"]).select(*KEYS, "intent", "text", "pos", "picked"))


@register("pairs_scan")
def q_pairs_scan(spark, d):
    """SRC-4: the pair sources written as TSV and CSV with lines that do not
    fit in between, read back by the checked scan; counts of both channels."""
    from ..operators import pairs
    from ..session import scratch_path
    src = pairs.build_pairs(fx.pair_sources(spark, d)).select(
        F.translate("input_text", '\n\t"', "   ").alias("sentence1"),
        F.translate("target_text", '\n\t"', "   ").alias("sentence2"))
    src = materialize(src.withColumn("label", F.when(F.length("sentence1") % 4 == 0, 0).otherwise(1)))
    out = []
    for fmt, sep in (("tsv", "\t"), ("csv", ",")):
        path = scratch_path(spark, f"pairs-{fmt}")
        src.write.option("header", True).option("sep", sep).csv(path)
        odd = src.where(F.length("sentence2") % 5 == 0).select(F.concat(
            F.length("sentence1").cast("string"), F.lit(f"{sep}two{sep}three{sep}four{sep}five")).alias("value"))
        odd = spark.createDataFrame([(f"sentence1{sep}sentence2{sep}label",)], "value string").unionByName(odd)
        odd.coalesce(1).write.mode("append").text(path)
        good, bad = pairs.scan_pairs(spark, path, fmt, source=fmt)
        out.append(good.groupBy("source", F.lit("kept").alias("channel")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("input_text") + F.length("target_text")).alias("chars")))
        out.append(bad.groupBy("source", F.lit("malformed").alias("channel")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars")))
    return std(out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]))


def _mode(name):
    def q(spark, d):
        from .experiments import run_mode
        fs, P, res = _mode_inputs(spark, d)
        return std(run_mode(name, fs, P, res).select(*KEYS, "intent", "text"))
    return q


for _name, _key in (("augment", "mode_augment"), ("human", "mode_human"),
                    ("augment_and_human", "mode_mixed"), ("human_inspired", "mode_inspired")):
    register(_key)(_mode(_name))


@register("mode_baseline")
def q_mode_baseline(spark, d):
    from .experiments import final_corpus, run_mode
    fs, P, res = _mode_inputs(spark, d)
    corpus = run_mode("baseline", fs, P, res)
    ents = fs.select(*KEYS, "intent", F.concat(F.lit("["), F.split("text", " ").getItem(1), F.lit("](item)"))
                     .alias("variant"), F.col("pos").alias("ord"), F.lit(0).alias("vord"))
    return std(final_corpus(corpus, ents).select(*KEYS, "intent", "text", "annotated"))


@register("mode_entities")
def q_mode_entities(spark, d):
    """RUN-5..7 with the entities of the full split: annotated, written with
    a regex block by run key, and read back raw."""
    from ..session import scratch_path
    from ..sources.corpus import read_raw
    from .experiments import HUMAN_MODES, run_mode_with_entities, write_mode
    fs, P, res = _mode_inputs(spark, d)
    mark = F.concat(F.lit("["), F.split("text", " ").getItem(1), F.lit("](item)")).alias("entity")
    full = P.select("intent", mark, "pos").groupBy("intent", "entity").agg(F.min("pos").alias("ord"))
    own = fs.select(*KEYS, "intent", mark, F.col("pos").alias("ord"))
    out = None
    for mode in HUMAN_MODES:
        corpus, variants = run_mode_with_entities(mode, fs, P, res, own, full)
        path = scratch_path(spark, f"mode-{mode}")
        write_mode(corpus, variants, path, regex_features=[("item", "[a-z]+")])
        rows = read_raw(spark, path, path).select(F.lit(mode).alias("mode"), *KEYS, "intent", "raw")
        out = rows if out is None else out.unionByName(rows)
    return std(out)
