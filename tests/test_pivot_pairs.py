"""Discovered pivot columns, pair files with lines that do not fit, mention offsets, softmax model."""

import math
import re

from pyspark.sql import functions as F

from uttermill.operators import entities, evaluate, pairs, softmax


def test_pivot_loses_no_intent(spark):
    rows = [(1, "a", 0.1), (1, "b", 0.2), (3, "a", 0.3), (3, "c", 0.4), (5, None, 0.5), (5, "d", 0.6)]
    s = spark.createDataFrame(rows, "train_n int, intent string, f1 double")
    every = evaluate.pivot_intents(s.where("intent IS NOT NULL"), values=["f1"])
    assert every.columns == ["train_n", "a", "b", "c", "d"]
    few = {r.train_n: r for r in evaluate.pivot_intents(s, values=["f1"], max_intents=2).collect()}
    assert few[1].a == 0.1 and few[1].b == 0.2 and few[1].others is None
    assert few[3].others["c"].f1 == 0.4 and few[5].others["d"].f1 == 0.6 and few[5].others[""].f1 == 0.5


def test_pair_files_with_odd_lines(spark, tmp_path):
    for fmt, sep in (("tsv", "\t"), ("csv", ",")):
        path = tmp_path / f"p.{fmt}"
        lines = [["sentence1", "sentence2", "label"], ["a b", "c d", "1"], ["too", "few"], ["x", "y", "0"],
                 ["one", "two", "1", "more"], ["é", "ü", "1"]]
        path.write_text("\n".join(sep.join(x) for x in lines) + "\n")
        good, bad = pairs.scan_pairs(spark, str(path), fmt, source=fmt)
        assert sorted((r.input_text, r.target_text) for r in good.collect()) == [("a b", "c d"), ("é", "ü")]
        assert sorted(r.line for r in bad.collect()) == sorted(sep.join(x) for x in (lines[2], lines[4]))
        assert good.count() == pairs.read_pairs(spark, str(path), fmt, source=fmt).count()


def test_mention_offsets_and_overlaps(spark):
    ex = spark.createDataFrame([("i", "The New York Times of new york, YORK times", 1), ("i", "nothing", 2),
                                ("j", "new york", 3), ("i", "aaaa İ new-york", 4), ("i", None, 5), ("i", "", 6)],
                               "intent string, text string, pos long")
    ents = spark.createDataFrame([("i", 1, 0, "[york](city)"), ("i", 2, 0, "[New York](city)"),
                                  ("i", 3, 0, "[new york times](paper)"), ("i", 4, 0, "[aa](x)"), ("i", 5, 0, "[a](y)")],
                                 "intent string, ord int, vord int, variant string")
    got = sorted((r.pos, r.start, r.stop, r.mention, r.etype) for r in entities.mention_spans(ex, ents).collect())
    assert got == [(1, 4, 18, "New York Times", "(paper)"), (1, 22, 30, "new york", "(city)"), (1, 32, 36, "YORK", "(city)"),
                   (4, 0, 2, "aa", "(x)"), (4, 2, 4, "aa", "(x)"), (4, 11, 15, "york", "(city)")]
    notes = {r.pos: r.annotated for r in entities.annotate(ex, ents).collect()}
    assert notes[1] == "The [New York Times](paper) of [new york](city), [YORK](city) times"
    assert notes[2] == "nothing" and notes[3] == "new york" and notes[5] is None and notes[6] == ""
    counts = {(r.pos, r.surface): r.n for r in entities.find_mentions(ex, ents).collect()}
    assert counts[1, "york"] == 3 and counts[1, "New York"] == 2 and counts[4, "a"] == 4


def grams(text):
    out = []
    for w in text.lower().split():
        p = f" {w} "
        out += [p[i:i + n] for n in range(1, min(4, len(p)) + 1) for i in range(len(p) - n + 1)]
    return sorted(out)


def test_character_grams(spark):
    texts = ["Ab c", "", "  xyz-1 ü ", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", softmax.char_grams(F.col("t")).alias("g")).collect():
        assert sorted(r.g) == grams(r.t)


def test_softmax_learns_and_confidences_add_up(spark):
    rows = [(1, c, f"{c} {w}", i) for i, (c, w) in enumerate((c, w) for c in ("red", "blue", "green") for w in ("x", "yy", "zzz"))]
    base = spark.createDataFrame(rows, "run int, intent string, text string, pos int")
    weights = softmax.train_softmax(base, ["run"], iterations=12)
    got = softmax.score_softmax(weights, base, ["run"]).collect()
    assert all(r.pred == r.intent and 1 / 3 < r.conf <= 1 for r in got) and len(got) == len(rows)
    new = spark.createDataFrame([(1, "?", "", 100), (2, "?", "red", 101)], base.schema)
    odd = softmax.score_softmax(weights, new, ["run"]).collect()
    assert [r.pos for r in odd] == [100] and math.isfinite(odd[0].conf)  # a run without a model has no prediction
    assert not re.search("nan", str(odd))
