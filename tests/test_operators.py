"""Small golden cases and properties from the reference's rules."""

from pyspark.sql import functions as F

from uttermill.operators import corpora, distance, evaluate, triage


def _corpus(spark, rows, keys=()):
    cols = list(keys) + ["intent", "text", "pos"]
    return spark.createDataFrame(rows, cols)


def test_merge_idempotent_commutative(spark):
    a = _corpus(spark, [("i1", "a", 1), ("i1", "b", 2), ("i2", "c", 3)])
    b = _corpus(spark, [("i1", "b", 5), ("i3", "d", 6)])
    ab = {tuple(r) for r in corpora.merge_corpora(a, b).collect()}
    ba = {tuple(r) for r in corpora.merge_corpora(b, a).collect()}
    aa = {tuple(r) for r in corpora.merge_corpora(a, a).collect()}
    assert ab == ba
    assert aa == {tuple(r) for r in a.collect()}
    assert {(r[0], r[1]) for r in ab} == {("i1", "a"), ("i1", "b"), ("i2", "c"), ("i3", "d")}


def test_subtract_keeps_duplicates_and_merge_loses_nothing(spark):
    base = _corpus(spark, [("i1", "a", 1)])
    new = _corpus(spark, [("i1", "a", 2), ("i1", "x", 3), ("i1", "x", 4), ("i2", "a", 5)])
    sub = corpora.subtract_corpus(base, new)
    assert sorted(r.pos for r in sub.collect()) == [3, 4, 5]
    merged = corpora.merge_corpora(base, sub)
    assert {(r.intent, r.text) for r in merged.collect()} == {("i1", "a"), ("i1", "x"), ("i2", "a")}


def test_limit_per_intent_bounds(spark):
    base = _corpus(spark, [("i1", "t0", 0)])
    new = _corpus(spark, [("i1", f"t{i}", i) for i in range(20)] + [("i2", "u", 99)])
    r = corpora.limit_per_intent(base, new, n=5).collect()
    per = {}
    for x in r:
        per.setdefault(x.intent, []).append(x.text)
    assert len(per["i1"]) == 5 and "t0" not in per["i1"] and per["i2"] == ["u"]


def test_fewshot_nested(spark):
    c = _corpus(spark, [("i1", f"t{i}", i) for i in range(10)])
    fs = corpora.fewshot_splits(c, sizes=(1, 3, 5), runs=2, checkpoint=False).collect()
    for run in (1, 2):
        s = {n: {r.text for r in fs if r.run == run and r.train_n == n} for n in (1, 3, 5)}
        assert len(s[1]) == 1 and len(s[3]) == 3 and len(s[5]) == 5
        assert s[1] <= s[3] <= s[5]


def test_min_distance_and_farthest(spark):
    origs = _corpus(spark, [("i", "kitten", 1), ("i", "mitten", 2)])
    cands = _corpus(spark, [("i", "sitting", 10), ("i", "kitten", 11), ("i", "abc", 12), ("j", "zz", 13)])
    d = {r.pos: r.dist for r in distance.min_distance(cands, origs).collect()}
    assert d == {10: 3, 11: 0, 12: 6, 13: None}
    top = distance.farthest_per_intent(distance.min_distance(cands, origs), k=2).collect()
    assert [r.pos for r in sorted(top, key=lambda r: (r.intent, r.rk))] == [12, 10, 13]


def test_jaccard(spark):
    origs = _corpus(spark, [("i", "a b c", 1)])
    cands = _corpus(spark, [("i", "a b d", 2), ("i", "x y", 3)])
    r = distance.jaccard_pairs(cands, origs, min_sim=0.1).collect()
    assert [(x.pos, x.orig_pos, round(x.sim, 6)) for x in r] == [(2, 1, 0.5)]


def test_class_report_golden(spark):
    # 4 utterances: a->a, a->b, b->b, b->c ; c is never true
    p = spark.createDataFrame([("1", "a", "a", 0.9), ("2", "a", "b", 0.4), ("3", "b", "b", 0.8),
                               ("4", "b", "c", 0.5)], ["text", "intent", "pred", "conf"])
    rep = {r.intent: r for r in evaluate.class_report(p).collect()}
    assert rep["a"].precision == 1.0 and rep["a"].recall == 0.5 and rep["a"].support == 2
    assert rep["b"].precision == 0.5 and rep["b"].recall == 0.5
    assert rep["c"].precision == 0.0 and rep["c"].recall == 0.0 and rep["c"].support == 0
    tot = evaluate.report_totals(evaluate.class_report(p)).first()
    assert tot.accuracy == 0.5 and abs(tot.weighted_recall - tot.accuracy) < 1e-12
    assert abs(tot.macro_precision - 0.5) < 1e-12
    conf = evaluate.confused_with(p, 3).collect()
    assert sorted((r.intent, r.confused, r.n) for r in conf) == [("a", "b", 1), ("b", "c", 1)]


def test_uncertain_threshold(spark):
    p = spark.createDataFrame([("1", "a", "a", 0.9), ("2", "a", "b", 0.95), ("3", "b", "b", 0.69),
                               ("4", "b", "b", 0.7)], ["text", "intent", "pred", "conf"])
    assert sorted(r.text for r in triage.uncertain(p, 0.7).collect()) == ["2", "3"]


def test_naive_bayes_scores(spark):
    base = spark.createDataFrame([("x", "good day"), ("x", "good"), ("y", "bad night")], ["intent", "text"])
    model = triage.train_nb(base)
    c = spark.createDataFrame([(1, "x", "good good"), (2, "y", "night"), (3, "x", "unknown")],
                              ["pos", "intent", "text"])
    r = {x.pos: x for x in triage.score_nb(model, c, ids=["pos"]).collect()}
    assert r[1].pred == "x" and r[2].pred == "y"
    assert r[3].pred == "x"  # priors only: 2/3 vs 1/3
    assert abs(r[3].conf - 2 / 3) < 1e-9
    assert all(0 < x.conf <= 1 for x in r.values())
