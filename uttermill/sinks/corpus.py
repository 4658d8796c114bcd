"""SNK-1: write corpora in the block text format

    version: "2.0"
    nlu:
    - regex: <name>            (optional feature blocks)
      examples: |
        - <pattern>
    - intent: <name>
      examples: |
        - <text>

Rows are range-partitioned and sorted by (run keys, intent, pos), so every
task writes a contiguous slice. Each written part file is a complete
document: a small per-partition formatter starts it with the header and
repeats the intent header when a block continues from the previous part.
No intent or run is ever gathered into one row or one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a part file, about.
PART_BYTES = 128 << 20
HEADER = ['version: "2.0"', "nlu:"]


def _regex_lines(regex_features) -> list[str]:
    out = []
    for name, pattern in regex_features or ():
        out += [f"- regex: {name}", "  examples: |", f"    - {pattern}"]
    return out


def render_lines(df: DataFrame, keys=(), regex_features=None, num_partitions: int | None = None) -> DataFrame:
    """Corpus rows -> one row per output line: keys, ``_ln`` (line order
    within its partition), ``line``."""
    k = list(keys)
    n = num_partitions
    if n is None:  # parts of a bounded size, at least one a core
        size = df.agg(F.sum(F.octet_length("text").cast("long") + 8)).first()[0] or 0
        n = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    rows = (df.select(*k, "intent", F.coalesce(F.col("pos").cast("long"), F.lit(0)).alias("pos"), "text")
            .repartitionByRange(n, *k, "intent", "pos", "text")
            .sortWithinPartitions(*k, "intent", "pos", "text"))
    head = HEADER + _regex_lines(regex_features)
    key_types = [f.simpleString() for f in rows.schema.fields if f.name in k]
    schema = ", ".join([f"`{c}` {t.split(':', 1)[1]}" for c, t in zip(k, key_types)]
                       + ["_ln long", "line string"])

    def fmt(batches):
        prev_key, prev_intent, ln = None, None, 0
        for pdf in batches:
            out_keys, out_ln, out_line = [], [], []
            for rec in pdf.itertuples(index=False):
                key = tuple(getattr(rec, c) for c in k)
                if key != prev_key:
                    if prev_key is not None:
                        out_keys.append(prev_key); out_ln.append(ln); out_line.append(""); ln += 1
                    for h in head:
                        out_keys.append(key); out_ln.append(ln); out_line.append(h); ln += 1
                    prev_key, prev_intent = key, None
                if rec.intent != prev_intent:
                    for h in (f"- intent: {rec.intent}", "  examples: |"):
                        out_keys.append(key); out_ln.append(ln); out_line.append(h); ln += 1
                    prev_intent = rec.intent
                out_keys.append(key); out_ln.append(ln); out_line.append(f"    - {rec.text}"); ln += 1
            if out_line:
                cols = {c: [kk[i] for kk in out_keys] for i, c in enumerate(k)}
                cols.update({"_ln": out_ln, "line": out_line})
                yield pd.DataFrame(cols)
        if prev_key is not None:
            cols = {c: [prev_key[i]] for i, c in enumerate(k)}
            cols.update({"_ln": [ln], "line": [""]})
            yield pd.DataFrame(cols)

    return rows.mapInPandas(fmt, schema)


def write_corpus(df: DataFrame, path: str, keys=(), regex_features=None, mode: str = "overwrite",
                 num_partitions: int | None = None) -> None:
    """SNK-1: one folder per run key (``partitionBy``), part files that are
    each a complete document. ``regex_features``: (name, pattern) pairs
    written after the header (the reference writes three for one dataset)."""
    k = list(keys)
    lines = render_lines(df, k, regex_features, num_partitions).sortWithinPartitions(*k, "_ln")
    w = lines.select(*k, "line").write.mode(mode)
    if k:
        w = w.partitionBy(*k)
    w.text(path)
