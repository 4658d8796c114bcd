"""Column-level helpers built from ``pyspark.sql.functions`` only (JVM side,
inside whole-stage code generation)."""

from .text import (ascii_fold, lemma_rule, md5_order, norm_paraphrase,
                   tokens_lower, tokens_space, words_ws)
from .vectors import cosine, dot, l2norm, unit

__all__ = [
    "ascii_fold", "lemma_rule", "md5_order", "norm_paraphrase", "tokens_lower",
    "tokens_space", "words_ws", "cosine", "dot", "l2norm", "unit",
]
