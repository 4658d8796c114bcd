"""Time cells of the temporal list join, and hot lines of the line dedup."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from uttermill.llm import line_dedup, url_filter
from uttermill.session import prepare

from . import reference as ref


def test_intervals_against_plain(spark):
    prepare(spark)
    rng = random.Random(5)
    start = datetime(2019, 12, 20)

    def time(days):
        return start + timedelta(seconds=rng.randrange(int(days * 86400)))
    entries = [(rng.choice("ab"), rng.choice(["x.org", "org.net", "s.x.org"]), time(rng.choice([0.1, 30, 900])),
                rng.random() < 0.6) for _ in range(400)]
    pages = [(i, f"http://{rng.choice(['s.x.org', 'x.org', 'org.net', 'y.z'])}/{i}", time(rng.choice([0.1, 40, 700])))
             for i in range(400)]
    got = {r.i: r.lists for r in url_filter.listed(
        spark.createDataFrame(pages, "i long, url string, fetched_at timestamp"),
        spark.createDataFrame(entries, "list string, domain string, at timestamp, active boolean")).collect()}
    for i, url, at in pages:
        h = url.split("/")[2]
        names = {h, h.split(".", 1)[1]} if h.count(".") > 1 else {h}
        want = set()
        for name in "ab":
            for d in names:
                before = [(t, on) for n, dom, t, on in entries if n == name and dom == d and t <= at]
                if before and max(before)[1]:
                    want.add(name)
        assert got[i] == sorted(want)


def test_cover_holds_each_time_once(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        a = rng.randrange(10 ** 9)
        rows.append((i, a, a + rng.choice([0, 1, 5000, 200_000, 10 ** 7, 10 ** 8])))
    df = spark.createDataFrame(rows, "i long, a long, b long").withColumns(
        {"a": F.timestamp_seconds("a"), "b": F.timestamp_seconds("b")})
    cover = url_filter.cover(df, F.col("a"), F.col("b"))
    asked = df.select("i", F.explode(F.array("a", "b", F.timestamp_seconds(
        (F.unix_seconds("a") + F.unix_seconds("b")) / 2))).alias("t")).distinct().select(
        "i", "t", F.inline(url_filter.cells_around(F.col("t"))))
    per = asked.join(cover, ["i", "level", "cell"]).groupBy("i", "t").count()
    assert {r["count"] for r in per.collect()} == {1}
    assert per.count() == len({(i, t) for i, a, b in rows for t in (a, b, (a + b) / 2)})


def test_hot_line_in_most_documents(spark):
    prepare(spark)
    rows = [(i, f"s{i % 40}", "same line here\n" + ("only on few" if i % 50 == 0 and i < 400 else f"own {i}"))
            for i in range(2000)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(
        spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == ref.line_dedup(rows)
