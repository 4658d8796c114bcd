"""Fixed values and default parameters.

FIXED VALUES (must equal the behaviour being reproduced, stated as text):

- Question words that keep themselves instead of synonyms:
  who, what, how, where, when, why, which, whom, whose
- Month names (full calendar names) used by the date test:
  january, february, march, april, may, june, july, august, september,
  october, november, december
- Short month forms used by the date test:
  jan, feb, march, april, may, june, july, august, sept, oct, nov, dec
- Detokenisation replacements for paraphrase pairs, applied in this order:
  " ." -> ".", " ?" -> "?", " !" -> "!", " ," -> ",", " ' " -> "'",
  " n't" -> "n't", " 'm" -> "'m", " 's" -> "'s", " 've" -> "'ve",
  " 're" -> "'re"
- Paraphrase near-equality ignores the characters ``? . ,`` and case.
- Entity annotation pattern: ``\\[[^)]*\\]\\([^)]*\\)``
- CamelCase split pattern: ``[A-Z](?:[a-z]+|[A-Z]*(?=[A-Z]|$))``
- Experiment modes: baseline, augment, human, augment_and_human,
  human_inspired
- Replaceable part-of-speech choices: verb, noun, verb_and_noun
- Synonym sources: wordnet (lexical table), sof (word vectors)
"""

WH_WORDS = ("who", "what", "how", "where", "when", "why", "which", "whom", "whose")

MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
MONTH_SHORT = ("jan", "feb", "march", "april", "may", "june", "july",
               "august", "sept", "oct", "nov", "dec")

DETOKENISE = (
    (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"),
    (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"),
    (" 're", "'re"),
)

ENTITY_PATTERN = r"\[[^)]*\]\([^)]*\)"
CAMEL_PATTERN = r"[A-Z](?:[a-z]+|[A-Z]*(?=[A-Z]|$))"

MODES = ("baseline", "augment", "human", "augment_and_human", "human_inspired")
POS_CHOICES = ("verb", "noun", "verb_and_noun")
SYNONYM_SOURCES = ("wordnet", "sof")

# Default experiment parameters (ours; the reference reads them from a
# settings module).
SEED = 42
TRAIN_SIZES = (1, 3, 5)
RUNS = 3
KEEP_BY_DISTANCE = 3
THRESHOLD = 0.7
PARAPHRASES_PER_INPUT = 3
LIMIT_PER_INTENT = 5

# Size guards for broadcasting derived tables (rows).
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 << 20
ARRAY_MAX_PER_GROUP = 10_000
