"""Corpus files in many splits."""

import re

from uttermill.sources import corpus


def plain(text):
    """(intent, example) of one file; the last block of an intent counts."""
    out = {}
    for block in re.split(r"(?m)^- (?=(?:intent|regex): )", text)[1:]:
        kind, name = re.match(r"(intent|regex): ([^\n]*)", block).groups()
        if kind == "intent":
            out[name.strip()] = re.findall(r"(?m)^\s+- (.*)$", block)
    return [(i, x) for i, xs in out.items() for x in xs]


def test_one_file_in_many_splits(spark, tmp_path):
    lines = ['version: "2.0"', "nlu:", "- regex: hash", "  examples: |", "    - [0-9a-f]+"]
    for i in range(6):
        lines += [f"- intent: name {i % 5}", "  examples: |"]
        lines += [f"    - example é{'x' * (k % 17)} {i} {k}" for k in range(40 if i else 300)]
    text = "\n".join(lines) + "\n"
    folder = tmp_path / "corpus"
    folder.mkdir()
    (folder / "a.yml").write_text(text)
    (folder / "b.yml").write_text(text.replace("name", "other"))
    want = sorted(plain(text) + plain(text.replace("name", "other")))
    assert len({i for i, _ in want}) == 10
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (70, 333, 1000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = corpus.read_raw(spark, str(folder)).collect()
            assert sorted((r.intent, r.raw) for r in rows) == want
            assert len({r.pos for r in rows}) == len(rows)
            for name in ("name 3", "other 3"):
                assert [r.raw for r in sorted((r for r in rows if r.intent == name), key=lambda r: r.pos)] == [
                    x for i, x in plain(text.replace("name", name.split()[0])) if i == name]
            regex = corpus.read_regex_features(spark, str(folder)).collect()
            assert [(r.name, r.pattern) for r in regex] == [("hash", "[0-9a-f]+")] * 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pieces_of_a_line_have_positions_of_their_own(spark, tmp_path):
    text = "- intent: a\n  examples: |\n    - " + "- ".join(f"p{i} " for i in range(250)) + "\n    - next\n"
    (tmp_path / "f.yml").write_text(text)
    rows = corpus.read_raw(spark, str(tmp_path)).collect()
    assert len(rows) == 251 and len({r.pos for r in rows}) == 251
    assert max(rows, key=lambda r: r.pos).raw == "next"
