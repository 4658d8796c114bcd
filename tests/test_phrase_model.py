"""The phrase-lattice paraphraser against all paths."""

import random
from math import log

from uttermill.operators import expand, phrase_model


def all_paths(tokens, phrases):
    if not tokens:
        yield 0.0, []
        return
    for j in range(1, len(tokens) + 1):
        edges = list(phrases.get(tuple(tokens[:j]), ()))
        if j == 1:
            edges.append((log(phrase_model.COPY), tokens[0]))
        for w, target in edges:
            for v, rest in all_paths(tokens[j:], phrases):
                yield w + v, [target, *rest]


def test_k_best_against_all_paths():
    rng = random.Random(1)
    for _ in range(200):
        phrases = {}
        for _ in range(rng.randint(0, 8)):
            src = tuple(rng.choice("abc") for _ in range(rng.randint(1, 3)))
            phrases[src] = [(log(rng.uniform(0.1, 1)), " ".join(rng.choice("abcx") for _ in range(rng.randint(1, 2))))
                            for _ in range(rng.randint(1, 3))]
        tokens = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        best = {}
        for w, path in all_paths(tokens, phrases):
            t = " ".join(path)
            best[t] = max(w, best.get(t, w))
        want = sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]
        got = phrase_model.Decoder(phrases, 4).best(" ".join(tokens))
        assert [t for _, t in got] == [t for t, _ in want]


def test_model_through_the_host(spark):
    pairs = spark.createDataFrame([("good day", "hello"), ("good day", "hello"), ("good day", "hi there"), ("day", "morning")],
                                  "input_text string, target_text string")
    utts = spark.createDataFrame([(1, "good day all"), (2, "good day all"), (3, "nothing known"), (4, "")], "pos int, text string")
    got = {}
    for r in expand.paraphrase_with_model(utts, phrase_model.model_factory(pairs, k=3), ["pos"]).collect():
        got.setdefault(r.pos, {})[r.k_i] = r.pred
    assert got[1] == got[2] == {1: "hello all", 2: "good morning all", 3: "hi there all"}
    assert got[3] == {1: "nothing known"} and got[4] == {1: ""}
