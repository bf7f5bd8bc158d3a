"""Small lexicons for the registered queries: fixed values, used by Spark and SQL alike."""

ANTONYMS = [("was", "is"), ("on", "off"), ("from", "to"), ("le", "la"), ("der", "die")]

SIMILARS = [
    ("news", "the", "a"),
    ("news", "of", "from"),
    ("news", "und", "oder"),
    ("news", "les", "des"),
    ("news", "with", "by"),
    ("tweets", "is", "be"),
    ("tweets", "that", "this"),
    ("tweets", "der", "den"),
    ("tweets", "la", "une"),
    ("news_senti", "was", "were"),
    ("news_senti", "for", "to"),
    ("news_senti", "le", "un"),
    ("tweets_senti", "in", "at"),
    ("tweets_senti", "et", "ou"),
    ("tweets_senti", "que", "qui"),
]

SENTI = ["was", "le", "der", "the", "with"]

# Parameters of the registered queries.
K = 2
SAMPLE_N = 1234
SAMPLE_SHARE = 0.35
FRACTION = 0.5
HOLDOUT_FOLD = 0
SVM_STEPS = 3
BUCKETS = 1000

# Bound of the majority class in the capped profile; low enough to bite from 10,000 sentences on.
CAP = 5_000
