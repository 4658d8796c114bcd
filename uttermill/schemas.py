"""Fixed schemas (no inference on read)."""

from pyspark.sql import types as T

EXAMPLES = T.StructType([
    T.StructField("train_n", T.IntegerType()), T.StructField("run", T.IntegerType()),
    T.StructField("intent", T.StringType()), T.StructField("pos", T.LongType()),
    T.StructField("text", T.StringType()),
])

ENTITIES = T.StructType([
    T.StructField("intent", T.StringType()), T.StructField("entity", T.StringType()),
    T.StructField("surface", T.StringType()), T.StructField("etype", T.StringType()),
    T.StructField("ord", T.IntegerType()),
])

PREDICTION_RECORD = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("intent_prediction", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ])),
])

REPORT_ENTRY = T.StructType([
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1-score", T.DoubleType()),
    T.StructField("support", T.LongType()),
    T.StructField("confused_with", T.MapType(T.StringType(), T.LongType())),
])

SYNONYMS = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("synonym", T.StringType()),
    T.StructField("rank", T.IntegerType()),
])

LEXICON = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("upos", T.StringType()),
    T.StructField("lemma", T.StringType()),
])

PAIRS = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("prefix", T.StringType()),
    T.StructField("input_text", T.StringType()), T.StructField("target_text", T.StringType()),
])
