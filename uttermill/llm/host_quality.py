"""Host-level quality rules.

Every document gets counts (one pass over its text, written beside it) and the
rules it breaks. Rule failures are summed by host, each host's failure rates
are shrunk with a beta prior fitted to the hosts themselves, and the host
verdicts are joined back: the base rules hold everywhere; a soft rule holds on
the hosts that break it habitually, those whose shrunk rate less its standard
deviation (of the beta posterior) reaches ``habit``. A single break on a host
that otherwise keeps the rule is taken as chance, and the document stays.

Nulls and odd rows: a null text has no words and breaks the base rules; a null
host is one host of its own; repeated rows are judged one by one; an empty
table gives an empty table; columns of ``docs`` are kept, and helper columns
get names that ``docs`` does not use.
"""

from __future__ import annotations

from collections import Counter
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..session import broadcast_if_small
from .common import fresh, release_memory, text_or_empty, written

#: Characters that count as symbols, and white space between words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Thresholds of the rules (production values).
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_SHARE = 0.3
WORD_LENGTH = (3.0, 10.0)
#: Failure rate from which a host breaks a rule habitually: one document in twenty.
HABIT = 0.05

BASE_RULES = ("short", "repeats")
SOFT_RULES = ("symbols", "dup_lines", "word_length")
RULES = BASE_RULES + SOFT_RULES
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SIGNALS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered[i:i + 3] = b"\x01\x01\x01"
    return sum(covered)


def signals(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(words))


@pandas_udf(SIGNALS)
def _signals(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for text in texts:
        found = pd.DataFrame([signals(t) for t in text], columns=COUNTS, dtype="int64")
        del text
        yield found
        release_memory()


def _broken(s) -> dict:
    """Rule -> boolean column over the struct of counts ``s``."""
    words = F.greatest(s["n_words"], F.lit(1))
    length = s["word_chars"] / words
    return {
        "short": s["n_words"] < MIN_WORDS,
        "repeats": 100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"],
        "symbols": s["n_symbols"] > MAX_SYMBOLS_PER_WORD * s["n_words"],
        "dup_lines": s["n_dup_lines"] > MAX_DUP_LINE_SHARE * s["n_lines"],
        "word_length": (length < WORD_LENGTH[0]) | (length > WORD_LENGTH[1]),
    }


def host_rates(judged: DataFrame, host: str, rules: dict) -> DataFrame:
    """host, n, fail_<rule> and rate_<rule>, the failure rate shrunk by the
    empirical beta prior: alpha = m * k, beta = (1 - m) * k with m the mean of
    the hosts' rates and k = m (1 - m) / variance - 1 (between 1 and 1000), so
    that (failures + alpha) / (n + k); and least_<rule>, that rate less the
    posterior's standard deviation. The moments are one row."""
    hosts = judged.groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c.cast("long")).alias(f"fail_{r}") for r, c in rules.items()])
    moments = hosts.agg(*[x for r in rules for x in (
        F.avg(F.col(f"fail_{r}") / F.col("n")).alias(f"m_{r}"),
        F.var_pop(F.col(f"fail_{r}") / F.col("n")).alias(f"v_{r}"))]).first()
    for r in rules:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        k = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        rate = (F.col(f"fail_{r}") + m * k) / (F.col("n") + k)
        hosts = hosts.withColumn(f"rate_{r}", rate).withColumn(
            f"least_{r}", rate - F.sqrt(rate * (1 - rate) / (F.col("n") + k + 1)))
    return hosts


def judge(docs: DataFrame, host: str = "source", text: str = "text", habit: float = HABIT,
          columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all without) and last a struct column
    ``quality`` (underscores in front if ``docs`` has that name): the counts,
    a boolean for each rule that the document breaks (``breaks_``) and for each
    soft rule that its host breaks habitually (``host_``), ``base_failed`` and
    ``kept``.

    The counts are written with the columns, so texts are read once. Hosts are
    aggregated map-side, so a hot host costs one row a task. Only the verdicts
    of failing hosts are joined back, broadcast behind a check of their size."""
    columns = docs.columns if columns is None else columns
    s, h = fresh("q_signals", docs.columns), fresh("q_host", docs.columns)
    judged = written(docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{host}`").alias(h),
                                 _signals(text_or_empty(text)).alias(s)), "signals")
    rules = _broken(F.col(s))
    verdict = F.struct(*[(F.col(f"least_{r}") >= habit).alias(r) for r in SOFT_RULES])
    strict = (host_rates(judged, h, {r: rules[r] for r in SOFT_RULES})
              .select(F.col("host").alias(f"{h}_name"), verdict.alias(f"{h}_bad"))
              .where(" OR ".join(f"{h}_bad.{r}" for r in SOFT_RULES)))
    joined = judged.join(broadcast_if_small(strict), F.col(h).eqNullSafe(F.col(f"{h}_name")), "left")
    bad = {r: F.coalesce(F.col(f"{h}_bad.{r}"), F.lit(False)) for r in SOFT_RULES}
    base = rules["short"] | rules["repeats"]
    soft = rules["symbols"] & bad["symbols"]
    for r in SOFT_RULES[1:]:
        soft = soft | (rules[r] & bad[r])
    quality = F.struct(F.col(f"{s}.*"), *[c.alias(f"breaks_{r}") for r, c in rules.items()],
                       *[c.alias(f"host_{r}") for r, c in bad.items()], base.alias("base_failed"),
                       (~base & ~soft).alias("kept"))
    return joined.select(*[F.col(f"`{c}`") for c in columns], quality.alias(fresh("quality", docs.columns)))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with the same columns."""
    judged = judge(docs, **options)
    return judged.where(F.col(judged.columns[-1])["kept"]).drop(judged.columns[-1])
