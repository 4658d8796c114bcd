"""Steps that must grow with their input only."""

import contextlib
import io
import random

import numpy as np
from pyspark.sql import functions as F

from tests.test_distance import lev, words
from uttermill.functions import edit
from uttermill.operators import corpora, distance, entities, expand, lexical, phrase_model, triage, vector_index


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_many_texts_share_the_letter_masks_of_a_block():
    rng = random.Random(11)
    texts = [words(rng, rng.choice([0, 1, 63, 64, 65, 130, 200]), "abcé中😀") for _ in range(260)] + [words(rng, 900, "abx")] * 3
    others = [words(rng, n, "abé😀z") for n in (0, 1, 64, 70, 150)] + ["qqq"]
    points, rest = [edit.code_points(t) for t in texts], [edit.code_points(t) for t in others]
    many = edit.Many(points, rest)
    assert many.blocks and many.alone.any()
    for o, p in zip(others, rest):
        some = np.array(sorted(rng.sample(range(len(texts)), 200)))
        assert many.distances(p, some).tolist() == [lev(texts[i], o) for i in some]
    some = edit.pieces(np.array([len(p) for p in points]), rest)
    assert np.concatenate(some).tolist() == list(range(len(texts)))


def test_naive_bayes_makes_no_rows_of_tokens(spark):
    base = spark.createDataFrame([(1, "x", "good day"), (1, "y", "bad night"), (2, "x", "bad"), (2, "y", "good")],
                                 "run int, intent string, text string")
    cands = spark.createDataFrame([(r, i, "x", t) for r in (1, 2, 3) for i, t in enumerate(["Good bad good", "", None, "day"])],
                                  "run int, pos long, intent string, text string")
    model = triage.train_nb(base, ["run"])
    got = triage.score_nb(model, cands, ["pos"])
    assert "Generate" not in plan(got) and "Exchange" not in plan(got)
    want = triage._score_nb_joined(model, cands, ["pos"], "text")
    rows = [{(r.run, r.pos): (r.pred, r.conf and round(r.conf, 12)) for r in df.collect()} for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) == 12 and rows[0][3, 0] == (None, None)


def test_one_per_origin_sorts_batches_only(spark):
    rng = random.Random(12)
    rows = [(rng.choice([1, None]), "x", rng.choice("abc"), rng.choice([None, 1, 2]), rng.choice([None, 5, 6]),
             rng.choice([None, 1, 2]), rng.choice(["error", "low cs", "success"])) for _ in range(400)]
    t = spark.createDataFrame(rows, "run int, intent string, text string, pos long, origin_pos long, dist int, category string")
    none = t.select("run", "intent", "text", "pos").limit(0)
    got = {(r.run, r.text, r.pos) for r in triage.best_per_origin(t, none, ["run"]).collect()}
    groups = {}
    for run, _, text, pos, origin, dist, cat in rows:
        if cat != "success":
            groups.setdefault((run, origin), []).append(
                (cat != "error", dist is None, -(dist or 0), pos is not None, pos or 0, text, run, pos))
    assert got == {(min(g)[6], min(g)[5], min(g)[7]) for g in groups.values()}
    assert "MapInArrow" in plan(triage.best_per_origin(t, none, ["run"]))


def test_picks_leave_most_rows_out_before_the_window(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("intent"), F.col("id").cast("string").alias("text"))
    rows = rows.withColumn("intent", F.when(F.col("intent") != "2", F.col("intent"))).withColumn("_h", F.md5("text"))
    few = corpora._lowest(rows, ["intent"], 5)
    assert 15 <= few.count() < 200
    best = {i: sorted(r._h for r in rows.where(F.col("intent").eqNullSafe(F.lit(i))).collect())[:5] for i in ("0", "1", None)}
    for i, want in best.items():
        assert sorted(r._h for r in few.where(F.col("intent").eqNullSafe(F.lit(i))).collect())[:5] == want


def test_a_phrase_table_beyond_broadcast_size_is_joined(spark, monkeypatch):
    rng = random.Random(13)

    def said(most):
        return " ".join(rng.choice("abcd") for _ in range(rng.randint(1, most)))

    pairs = spark.createDataFrame([(said(3), said(2)) for _ in range(300)], "input_text string, target_text string")
    utts = spark.createDataFrame([(i, said(7)) for i in range(60)] + [(99, "none of them"), (98, "")], "pos int, text string")

    def predictions():
        model = phrase_model.model_factory(pairs, k=3)
        return sorted(map(tuple, expand.paraphrase_with_model(utts, model, ["pos"]).collect()))

    want = predictions()
    monkeypatch.setattr(phrase_model, "collect_if_small", lambda df: None)
    assert isinstance(phrase_model.model_factory(pairs), phrase_model.JoinedModel)
    assert predictions() == want and len(want) > 100


def test_vectors_travel_once_per_block_and_ties_keep_the_smaller_words(spark, monkeypatch):
    rng = np.random.default_rng(14)
    vecs = rng.normal(size=(1300, 6)) + 4 * rng.normal(size=(8, 6))[rng.integers(0, 8, 1300)]
    vecs[700:900] = vecs[5]  # copies
    rows = [(f"w{i:04}", v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "word string, vec array<double>")
    monkeypatch.setattr(vector_index, "BLOCK", 600)
    index = vector_index.VectorIndex(df, lists=12)
    words = index.members.select(F.col("_v").alias("_q"), "_vec")
    got = {}
    for r in index.nearest(words, 3, probes=2).collect():
        got.setdefault(r._q, {})[r.rank] = (r.synonym, r.sim)
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -np.inf)
    for i, (w, _) in enumerate(rows):
        best = np.sort(sims[i])[::-1][:3]
        assert np.allclose([got[w][r][1] for r in (1, 2, 3)], best), w
    copies = [f"w{i:04}" for i in (5, *range(700, 900))]
    assert [got["w0800"][r][0] for r in (1, 2, 3)] == copies[:3]
    q, blocks = index.dealt(index.members, "_v", index.size, 600, "_b")
    assert 3 <= blocks <= 6 and q.count() == 1300  # a vector travels to few blocks, however many lists it visits
    assert max(r["count"] for r in q.groupBy("_b").count().collect()) <= 700


def test_top_of_rows():
    sims = np.array([[1.0, 2, 2, 2, 0], [-np.inf, -np.inf, 3, -np.inf, 1], [5, 4, 3, 2, 1]])
    r, c = vector_index._top(sims, np.array([-np.inf, -np.inf, 4.5]), 2)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 1), (0, 2), (1, 2), (1, 4), (2, 0)]


def test_mentions_are_found_where_the_utterance_stands(spark, monkeypatch):
    rng = random.Random(15)

    def said(n):
        return "".join(rng.choice("abAB cÉé") for _ in range(n))

    texts = [(i, rng.choice(["x", "y", "z", None]), said(rng.randint(0, 30))) for i in range(120)] + [(500, "x", None), (501, "x", "İab ΑΣ ab")]
    ex = spark.createDataFrame(texts, "pos int, intent string, text string")
    for few in (1, 60):
        surfaces = sorted({(i, said(rng.randint(1, 4)).strip() or "ab") for i in "xy" for _ in range(few)})
        va = spark.createDataFrame([(i, n, 0, f"[{s}](t{n % 3})") for n, (i, s) in enumerate(surfaces)],
                                   "intent string, ord int, vord int, variant string")
        both = [sorted(map(tuple, entities.mention_spans(ex, va).collect()))]
        assert "Generate" not in plan(entities._with_spans(ex, va, (), "text"))
        with monkeypatch.context() as m:
            m.setattr(entities, "collect_if_small", lambda df: None)
            both.append(sorted(map(tuple, entities.mention_spans(ex, va).collect())))
        assert both[0] == both[1] and both[0]


def test_lemmas_replace_words_where_they_stand(spark, monkeypatch):
    lex = spark.createDataFrame([("runs", "run"), ("run", "run"), ("odd", None), ("a", "b"), ("b", "c")], "word string, lemma string")
    lex = lex.withColumn("upos", F.lit(None).cast("string"))
    df = spark.createDataFrame([(1, "runs  a b odd "), (2, ""), (3, None), (4, "none here")], "pos int, text string")
    got = lexical.lemmatise(df, lex, ["pos"])
    assert "Generate" not in plan(got) and "Exchange" not in plan(got)
    rows = [sorted(map(tuple, got.collect()))]
    monkeypatch.setattr(lexical, "collect_if_small", lambda df: None)
    rows.append(sorted(map(tuple, lexical.lemmatise(df, lex, ["pos"]).collect())))
    assert rows[0] == rows[1] == [(1, "run  b c odd "), (2, ""), (4, "none here")]


def test_farthest_by_counts_of_lengths(spark):
    rng = random.Random(16)
    rows = sorted({(rng.choice("xyz"), words(rng, rng.choice([1, 2, 5, 9, 30]))) for _ in range(150)} | {("few", "ab"), ("few", "c")})
    lines = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "intent string, text string, pos long")
    fs = corpora.fewshot_splits(lines)
    cols = ["train_n", "run", "intent", "text", "dist", "rk"]
    far = distance.farthest_from_fewshot(lines, fs, [1, 3, 5], 3)
    want = distance.farthest_per_intent(distance.min_distance_fewshot(lines, fs, [1, 3, 5]), 3, ["train_n", "run"])
    got = [sorted(map(tuple, x.select(cols).collect())) for x in (far, want)]
    assert got[0] == got[1] and got[0]


def test_similar_pairs_meet_the_rows_of_all_runs_by_broadcast(spark):
    cands = spark.createDataFrame([(r, "x", f"a b c{i}", i) for r in (1, 2) for i in range(20)], "run int, intent string, text string, pos long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = distance.jaccard_pairs(cands, cands.where("pos = 3"), ["run"], 0.5)
        assert "SortMergeJoin" not in plan(got) and got.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
