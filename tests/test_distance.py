"""Edit distance kernel, nearest originals (broadcast and indexed), prefix-filter join."""

import random

import pytest
from pyspark.sql import functions as F

from uttermill.functions.edit import Originals, Prefixes, pair_distances
from uttermill.operators import distance


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def words(rng, n, letters="abcdé "):
    return "".join(rng.choice(letters) for _ in range(n))


def test_kernel_matches_dynamic_programme():
    rng = random.Random(1)
    sizes = [0, 1, 5, 62, 63, 64, 65, 127, 128, 129, 200]
    a = [words(rng, rng.choice(sizes), "abé中") for _ in range(400)]
    b = [words(rng, rng.choice(sizes), "abéx😀") for _ in range(400)]
    assert pair_distances(a, b).tolist() == [lev(x, y) for x, y in zip(a, b)]
    assert pair_distances([], []).tolist() == []


def test_nearest_visits_what_it_must():
    rng = random.Random(2)
    origs = [words(rng, rng.randint(0, 40)) for _ in range(120)] + ["same", "same"]
    pos = [rng.choice([None, i, i % 7]) for i in range(len(origs))]
    group = Originals(origs, pos)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(80)] + ["same", ""]
    best, at = group.nearest(texts)
    for t, d, j in zip(texts, best.tolist(), at.tolist()):
        want = min((lev(t, o), p is not None, p or 0, o) for o, p in zip(origs, pos))
        assert (d, group.pos[j] is not None, group.pos[j] or 0, group.texts[j]) == want


def test_prefixes_of_nested_splits():
    rng = random.Random(3)
    rows = [(run, k + 1, words(rng, rng.randint(1, 30)), rng.randint(0, 5), "o") for run in (1, 2) for k in range(run + 2)]
    texts = [words(rng, rng.randint(0, 30)) for _ in range(60)]
    found = Prefixes(rows).nearest(texts, [1, 3, 5])
    for run in (1, 2):
        for n in (1, 3, 5):
            for t, d in zip(texts, found[run, n][0].tolist()):
                assert d == min(lev(t, r[2]) for r in rows if r[0] == run and r[1] <= n)


def frames(spark, cands, origs):
    cols = "g int, intent string, text string, pos long"
    return spark.createDataFrame(cands, cols), spark.createDataFrame(origs, cols)


def test_indexed_equals_broadcast(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 20)
    rng = random.Random(4)
    origs = [(i % 2, rng.choice(["a", "b"]), words(rng, rng.randint(1, 80)), i) for i in range(150)]
    cands = [(i % 3, rng.choice(["a", "b", "c"]), words(rng, rng.randint(0, 80)), i) for i in range(60)]
    for i, (g, intent, t, _) in enumerate(origs[:60]):  # near copies
        cands.append((g, intent, t[:10] + rng.choice(["", "x", "yz"]) + t[10:], 100 + i))
    cands += [(0, "a", None, 900), (None, "a", "x", 901)]
    c, o = frames(spark, cands, origs + [(0, None, "n", 5), (0, "a", None, 6)])
    both = [{r.pos: (r.dist, r.origin_text, r.origin_pos) for r in distance.min_distance(
        c, o, ["g"], with_nearest=True, max_rows=n).collect()} for n in (10**6, 0)]
    assert both[0] == both[1] and len(both[0]) == len(cands)
    for g, intent, t, p in cands:
        mine = [(lev(t, ot), op, ot) for og, oi, ot, op in origs if (og, oi) == (g, intent)] if t is not None else []
        want = min(mine) if mine else (None,) * 3
        assert both[0][p] == (want[0], want[2], want[1])


def test_index_finds_all_near_originals(spark):
    rng = random.Random(5)
    origs = [(0, "a", words(rng, rng.randint(1, 120), "abcdefgh "), i) for i in range(200)]
    cands = []
    for i, (_, _, t, _) in enumerate(origs):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 12))):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
        cands.append((0, "a", "".join(t), i))
    c, o = frames(spark, cands, origs)
    near = {r._rid: r._d for r in distance.near_originals(
        c.select(F.col("pos").alias("_rid"), "intent", F.col("text").alias("_t")),
        o.select("intent", F.col("text").alias("_t"), F.col("pos").alias("_p")), ["intent"]).collect()}
    want = {p: min(lev(t, ot) for _, _, ot, _ in origs) for _, _, t, p in cands}
    assert near == {p: d for p, d in want.items() if d <= int(len(cands[p][2]) * distance.NEAR_SHARE)} and near


@pytest.mark.parametrize("sim", [0.1, 0.25, 0.5, 0.8, 1.0])
def test_jaccard_prefix_join_against_all_pairs(spark, sim):
    rng = random.Random(6)

    def text():
        return " ".join(rng.choice("a b c d e f g h i j k l m".split()) for _ in range(rng.randint(0, 9)))

    cands = [(rng.choice([1, 2]), rng.choice(["x", "y"]), text(), i) for i in range(80)]
    origs = [(rng.choice([1, 2]), rng.choice(["x", "y"]), text(), i) for i in range(40)] + [(1, "x", cands[0][2], 77)]
    c, o = frames(spark, cands, origs)
    got = sorted((r.pos, r.orig_pos, round(r.sim, 9)) for r in distance.jaccard_pairs(c, o, ["g"], sim).collect())
    want = []
    for g, i, t, p in cands:
        for og, oi, ot, op in origs:
            a, b = set(t.split()), set(ot.split())
            if (g, i) == (og, oi) and a & b and len(a & b) / len(a | b) >= sim:
                want.append((p, op, round(len(a & b) / len(a | b), 9)))
    assert got == sorted(want)


def test_ten_thousand_originals_of_one_intent(spark):
    rng = random.Random(7)
    origs = [(0, "a", words(rng, rng.randint(20, 60), "abcdefghij "), i) for i in range(10_000)]
    cands = [(0, "a", t[:7] + "z" + t[8:], i) for i, (_, _, t, _) in enumerate(origs[:40])]
    c, o = frames(spark, cands, origs)
    assert all(r.dist <= 1 for r in distance.min_distance(c, o, ["g"]).collect())
