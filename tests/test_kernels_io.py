"""Edit distances, run-tree readers, entities, combinations."""

import json
import os
import random

from pyspark.sql import functions as F

from uttermill.operators import entities, expand
from uttermill.session import scratch_path
from uttermill.sources import logs
from uttermill.sources.corpus import extract_entities, read_corpus, read_raw


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_min_distance_matches_dynamic_programme(spark):
    from uttermill.operators.distance import min_distance
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choice("abcé ") for _ in range(n))
    originals = [("i", word(rng.randint(0, 90)), k) for k in range(12)] + [("j", "x", 0)]
    cands = [("i", word(rng.randint(0, 90)), k) for k in range(60)] + [("none", "x", 99)]
    cols = ["intent", "text", "pos"]
    got = min_distance(spark.createDataFrame(cands, cols), spark.createDataFrame(originals, cols),
                       with_nearest=True).collect()
    for r in got:
        want = min([(_lev(r.text, t), p) for i, t, p in originals if i == r.intent], default=(None, None))
        assert (r.dist, r.origin_pos) == want


def test_annotate_quotes_and_folds(spark):
    ex = spark.createDataFrame([("a", "price $x(1) and \u00c9T\u00c9 \\\\E end", 1)], ["intent", "text", "pos"])
    va = spark.createDataFrame([("a", 1, 0, "[\u00e9t\u00e9]($m\\\\1)"), ("a", 2, 0, "[$x](c)")],
                               ["intent", "ord", "vord", "variant"])
    out = entities.annotate(ex, va).first().annotated
    assert "[\u00c9T\u00c9]($m\\\\1)" in out and "[$x](c)" in out


def test_paraphrase_uses_runs_of_any_length(spark):
    u = spark.createDataFrame([(1, "please how do i fix this today")], ["id", "text"])
    p = spark.createDataFrame([("how do i fix this", "how to fix it"), ("fix this", "mend")],
                              ["input_text", "target_text"])
    assert [r.pred for r in expand.paraphrase_with_pairs(u, p, ["id"], k=1).collect()] == [
        "please how to fix it today"]


def test_combinations_do_not_overflow(spark):
    lists = spark.createDataFrame([(1, [["a", "b", "c", "d"]] * 40)], "id int, lists array<array<string>>")
    rows = expand.expand_combinations(lists, ["id"], max_per_example=5).orderBy("idx").collect()
    assert [r.text.split()[-2:] for r in rows] == [["a", x] for x in "abcd"] + [["b", "a"]]


def test_human_mode_keeps_every_run(spark):
    from uttermill.operators import corpora
    o = spark.createDataFrame([(10, 7, "a", "x", 1)], ["train_n", "run", "intent", "text", "pos"])
    h = spark.createDataFrame([("a", "y", 2)], ["intent", "text", "pos"])
    assert [(r.train_n, r.run, r.text) for r in corpora.for_each_split(h, o).collect()] == [(10, 7, "y")]


def test_reference_layout_readers(spark, tmp_path):
    base = tmp_path / "repository" / "augment_and_human_train_1-3_cs_threshold_0.7_2021-08-05_15-12"
    loop = base / "train_3" / "run_2" / "results" / "loop_1"
    loop.mkdir(parents=True)
    errs = [{"text": "show bugs", "intent": "a", "intent_prediction": {"name": "b", "confidence": 0.4}}]
    oks = [{"text": "list files", "intent": "b", "intent_prediction": {"name": "b", "confidence": 0.9}}]
    (loop / "intent_errors.json").write_text(json.dumps(errs, indent=2))
    (loop / "intent_successes.json").write_text(json.dumps(oks, indent=2))
    report = {"a": {"precision": 0.0, "recall": 0.0, "f1-score": 0.0, "support": 1, "confused_with": {"b": 1}},
              "b": {"precision": 0.5, "recall": 1.0, "f1-score": 0.6667, "support": 1},
              "accuracy": 0.5, "macro avg": {"precision": 0.25, "recall": 0.5, "f1-score": 0.333, "support": 2},
              "weighted avg": {"precision": 0.25, "recall": 0.5, "f1-score": 0.333, "support": 2}}
    (loop / "intent_report.json").write_text(json.dumps(report, indent=2))
    lev = base / "train_3" / "run_2" / "lev_distance_filter" / "loop_1"
    lev.mkdir(parents=True)
    (lev / "lev_distance_filter_results.json").write_text(json.dumps({"a": ["x", "y"], "b": ["z"]}, indent=4))

    p = logs.read_predictions(spark, str(tmp_path), layout="tree").collect()
    assert sorted((r.text, r.outcome, r.train_n, r.run, r.loop, r.exp_type, r.dataset) for r in p) == [
        ("list files", "success", 3, 2, 1, "augment_and_human", "repository"),
        ("show bugs", "error", 3, 2, 1, "augment_and_human", "repository")]
    per, tot = logs.read_reports(spark, str(tmp_path), layout="tree")
    rows = {r.intent: r for r in per.collect()}
    assert rows["a"].confused_with == {"b": 1} and rows["b"].support == 1
    t = tot.first()
    assert t.accuracy == 0.5 and t.weighted_recall == 0.5 and t.support == 2
    f = logs.read_filter_results(spark, str(tmp_path), layout="tree").collect()
    assert sorted((r.intent, r.text) for r in f) == [("a", "x"), ("a", "y"), ("b", "z")]
    assert logs.read_predictions(spark, str(tmp_path / "nothing"), layout="written").count() == 0


def test_corpus_reader_rules(spark, tmp_path):
    doc = ('version: "2.0"\nnlu:\n- regex: issue_number\n  examples: |\n    - #?[0-9]+\n'
           "- intent: Q\n  examples: |\n    - which [Foo.java](filename) has bug(s)?\n"
           "    - from 2020-01-01 - 2020-02-01\n    - a- b\n- intent: R\n  examples: |\n    - old\n"
           "- intent: R\n  examples: |\n    - new\n")
    (tmp_path / "c.yml").write_text(doc)
    rows = sorted((r.intent, r.text) for r in read_corpus(spark, str(tmp_path / "c.yml")).collect())
    assert rows == [("Q", "a"), ("Q", "b"), ("Q", "from 2020-01-01  2020-02-01"), ("Q", "which Foo.java has bug?"),
                    ("R", "new")]
    ents = extract_entities(read_raw(spark, str(tmp_path / "c.yml"))).collect()
    assert [(e.intent, e.entity, e.surface, e.etype) for e in ents] == [("Q", "[Foo.java](filename)", "Foo.java", "filename")]


def test_entity_variants_and_annotation(spark):
    e = spark.createDataFrame([("i", "[src/Main.java](file)", 1), ("i", "[March 3](time)", 2)], ["intent", "entity", "ord"])
    v = [r.variant for r in entities.expand_entities(e).orderBy("ord", "vord").collect()]
    assert v == ["[src/Main.java](file)", "[src Main.java](file)", "[src-Main.java](file)", "Main(file)",
                 "[src/Main .java](file)", "[src/Main. java](file)", "[March 3](time)"]
    ex = spark.createDataFrame([("i", "open Main.java and main.java", 1)], ["intent", "text", "pos"])
    ents = spark.createDataFrame([("i", "[main.java](file)", 1, 0), ("i", "[java](lang)", 2, 0)],
                                 ["intent", "variant", "ord", "vord"])
    out = entities.annotate(ex, ents).first().annotated
    assert out == "open [Main.java](file) and [main.java](file)"


def test_combinations_order_and_count(spark):
    lists = spark.createDataFrame([(1, [["a", "b"], ["x"], ["1", "2", "3"]])], ["id", "lists"])
    rows = expand.expand_combinations(lists, ["id"]).orderBy("idx").collect()
    assert [r.text for r in rows] == ["a x 1", "a x 2", "a x 3", "b x 1", "b x 2", "b x 3"]
