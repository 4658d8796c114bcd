"""uttermill: grow and judge labelled utterance corpora with Spark DataFrames.

Every operator is a plain function ``DataFrame -> DataFrame``. Run keys
(``train_n``, ``run`` and optionally ``dataset``/``loop``) are ordinary
leading group columns, so one Spark job covers a whole experiment grid.
"""

__all__ = ["config", "session", "schemas"]
