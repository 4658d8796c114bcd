"""Experiment composition (RUN-1..7): every mode is one lazy DataFrame
plan over all splits (train_n, run) of an experiment.

Inputs
- ``originals``: few-shot corpus rows (train_n, run, intent, text, pos);
- ``human``: the full train split (intent, text, pos), shared by all runs;
- ``lexicon``, ``synonyms`` tables, the paraphrase ``pairs`` table (or a
  plug-in model) for the expansion steps.

Outputs are corpora (train_n, run, intent, text, pos); ``final_corpus``
annotates them and the sinks write them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import corpora, distance, entities, expand, lexical, triage
from ..session import materialize
from ..sinks.corpus import write_corpus

KEYS = ["train_n", "run"]


@dataclass
class Resources:
    lexicon: DataFrame
    synonyms: DataFrame
    pairs: DataFrame
    part_of_speech: str = "verb"
    synonyms_source: str = "wordnet"
    vectors: DataFrame | None = None
    number_of_synonyms: int = 10
    k_paraphrases: int = config.PARAPHRASES_PER_INPUT


def synonym_stage(originals: DataFrame, res: Resources) -> DataFrame:
    """EXP-1..5: originals and their synonym combinations (bag), with
    ``origin_pos``; the synonym-only variants feed the paraphraser."""
    ids = KEYS + ["intent", "pos"]
    tok = lexical.tokenize(originals, ids)
    tagged = lexical.mark_replaceable(lexical.tag_tokens(tok, res.lexicon), ids, res.part_of_speech)
    syn = lexical.candidate_synonyms(tagged, res.synonyms_source, synonyms=res.synonyms,
                                     vectors=res.vectors, n=res.number_of_synonyms)
    combos = expand.expand_combinations(expand.synonym_lists(syn, ids), ids)
    o = originals.select(*KEYS, "intent", "text", F.col("pos").alias("origin_pos"))
    return o.unionByName(combos.select(*KEYS, "intent", "text", F.col("pos").alias("origin_pos")))


def paraphrase_stage(stage: DataFrame, res: Resources) -> DataFrame:
    """EXP-7/8: paraphrases of every stage input (distinct inputs), cleaned;
    each keeps the origin of its input (EXP-6)."""
    inputs = stage.groupBy(*KEYS, "intent", "text").agg(F.min("origin_pos").alias("origin_pos"))
    para = expand.paraphrase_with_pairs(inputs, res.pairs, KEYS + ["intent", "text"], k=res.k_paraphrases)
    cleaned = expand.clean_paraphrases(para, KEYS + ["intent"], src="text")
    return (cleaned.join(inputs, KEYS + ["intent", "text"])
            .select(*KEYS, "intent", F.col("pred").alias("text"), "origin_pos",
                    F.lit("paraphrase").alias("gen_step")))


def candidates(originals: DataFrame, res: Resources) -> DataFrame:
    """EXP-9: originals ++ paraphrases (of originals and their variants).
    Checkpointed: the candidate set feeds scoring, distances and merges."""
    para = paraphrase_stage(synonym_stage(originals, res), res)
    return materialize(expand.assemble(originals, para, KEYS))


def _as_corpus(df: DataFrame) -> DataFrame:
    pos = F.col("origin_pos") if "origin_pos" in df.columns else F.col("pos")
    return df.select(*KEYS, "intent", "text", pos.alias("pos"))


def filter_corpus(initial: DataFrame, new: DataFrame, k: int = config.KEEP_BY_DISTANCE,
                  threshold: float = config.THRESHOLD, merge: bool = True,
                  lexicon: DataFrame | None = None) -> DataFrame:
    """RUN-2: naive Bayes trained on ``initial`` scores the distinct texts
    of ``new`` (TRI-1), the uncertain ones survive (TRI-2), per intent the
    ``k`` farthest from ``initial`` by lemmatised edit distance are kept
    (DST-1..3), optionally merged with ``initial`` (SET-1). One pass (the
    reference's repeat loop returns after its first iteration)."""
    cand = new.groupBy(*KEYS, "intent", "text").agg(F.min("origin_pos" if "origin_pos" in new.columns
                                                          else "pos").alias("pos"))
    model = triage.train_nb(initial, keys=KEYS)
    scored = triage.score_nb(model, cand, ids=["intent", "text"])
    kept = triage.uncertain(scored, threshold)
    if lexicon is not None:
        kept = kept.join(lexical.lemmatise(kept, lexicon, KEYS + ["intent", "text"], out="_lc"),
                         KEYS + ["intent", "text"])
        init = initial.join(lexical.lemmatise(initial, lexicon, KEYS + ["intent", "text"], out="_lo"),
                            KEYS + ["intent", "text"])
        dist = distance.min_distance(kept, init, keys=KEYS, cand_col="_lc", orig_col="_lo")
    else:
        dist = distance.min_distance(kept, initial, keys=KEYS)
    dist = dist.withColumn("is_error", F.col("pred") != F.col("intent"))
    top = distance.farthest_per_intent(dist, k, keys=KEYS, first="is_error").select(*KEYS, "intent", "text", "pos")
    return corpora.merge_corpora(_as_corpus(initial), top, KEYS) if merge else top


def triage_by_origin(originals: DataFrame, new: DataFrame, lexicon: DataFrame,
                     threshold: float = config.THRESHOLD) -> DataFrame:
    """TRI-3 by provenance: the distinct generated texts, each with the
    original it comes from (EXP-6: a paraphrase's input is a variant of the
    original, whose position every step carries), scored by naive Bayes
    trained on the originals. Output: keys, intent, text, pos and origin_pos
    (the original's), origin_text, pred, conf, category, and dist, the edit
    distance of the lemmatised text and original (DST-1, DST-4). Texts equal
    to their original are left out."""
    ids = KEYS + ["intent", "text"]
    cand = expand.trace_origin(new, KEYS)
    scored = triage.score_nb(triage.train_nb(originals, keys=KEYS), cand, ids=["intent", "text"])
    o = originals.select(*KEYS, "intent", F.col("pos").alias("origin_pos"), F.col("text").alias("origin_text"))
    t = triage.triage_table(scored.join(o, KEYS + ["intent", "origin_pos"]), threshold)
    t = t.join(lexical.lemmatise(t, lexicon, ids, out="_lt"), ids)
    lo = lexical.lemmatise(o.select(*KEYS, "intent", "origin_text").distinct(), lexicon,
                           KEYS + ["intent", "origin_text"], text="origin_text", out="_lo")
    t = distance.pair_distance(t.join(lo, KEYS + ["intent", "origin_text"]), "_lt", "_lo")
    return t.drop("_lt", "_lo").withColumn("pos", F.col("origin_pos"))


def run_mode(mode: str, originals: DataFrame, human: DataFrame, res: Resources,
             k: int = config.KEEP_BY_DISTANCE, threshold: float = config.THRESHOLD,
             seed=config.SEED) -> DataFrame:
    """RUN-3..7: the corpus a mode produces for every split."""
    if mode not in config.MODES:
        raise ValueError(f"mode must be one of {config.MODES}, got {mode!r}")
    o = _as_corpus(originals)
    if mode == "baseline":
        return o
    if mode == "human":
        h = corpora.for_each_split(human.select("intent", "text", "pos"), o, KEYS)
        return corpora.merge_corpora(o, h, KEYS)
    cand = candidates(originals, res)
    if mode == "augment":
        return corpora.merge_corpora(o, _as_corpus(cand), KEYS)
    lex = res.lexicon
    h = corpora.for_each_split(human.select("intent", "text", "pos"), o, KEYS)
    if mode == "augment_and_human":
        filtered = filter_corpus(o, cand, k, threshold, merge=True, lexicon=lex)
        # the merged originals already hold the kept paraphrases (in-place merge)
        one = corpora.one_per_intent(corpora.subtract_corpus(filtered, h, KEYS), seed, KEYS)
        return corpora.merge_corpora(one.select(*KEYS, "intent", "text", "pos"), filtered, KEYS)
    # human_inspired
    inspired = corpora.limit_per_intent(o, h, config.LIMIT_PER_INTENT, seed, KEYS)
    new = corpora.subtract_corpus(o, cand, KEYS)
    kept = filter_corpus(inspired.select(*KEYS, "intent", "text", "pos"), new, k, threshold,
                         merge=False, lexicon=lex)
    return corpora.merge_corpora(kept, o, KEYS)


#: Modes whose entities are those of the full train split instead of the run's.
HUMAN_MODES = ("human", "augment_and_human", "human_inspired")


def run_mode_with_entities(mode: str, originals: DataFrame, human: DataFrame, res: Resources, own: DataFrame,
                           full: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """RUN-3..7 with both outputs: the corpus of every split, and the entity
    variants (ENT-1) to annotate it with. ``own``: entities of the runs'
    originals (keys, intent, entity, ord); ``full``: those of the full train
    split (intent, entity, ord), which replace them in every run of a mode
    that uses it."""
    corpus = run_mode(mode, originals, human, res, **options)
    chosen = corpora.for_each_split(full, originals, KEYS) if mode in HUMAN_MODES else own
    return corpus, entities.expand_entities(chosen, keys=KEYS)


def write_mode(corpus: DataFrame, variants: DataFrame, path: str, regex_features=None) -> None:
    """The annotated corpus of every split in block text, a folder a run key
    (SNK-1), with the regex blocks."""
    annotated = final_corpus(corpus, variants).select(*KEYS, "intent", F.col("annotated").alias("text"), "pos")
    write_corpus(annotated, path, keys=KEYS, regex_features=regex_features)


def final_corpus(corpus: DataFrame, variants: DataFrame) -> DataFrame:
    """RUN-3 tail: annotate the corpus with the entity variants (ENT-3)."""
    return entities.annotate(corpus, variants, keys=KEYS)
