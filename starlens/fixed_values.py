"""Fixed values that results depend on, stated together in natural order."""

# The English stop-word list used for word statistics
# (the widely published NLTK English list, 179 entries, in its own order).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# Negation words recognised by the lexicon sentiment scorer.
NEGATIONS = ["not", "no", "never", "n't", "ne", "pas", "jamais", "nicht", "kein", "nie", "nunca"]

# Train / validation / test fractions and seed of the split.
SPLIT_WEIGHTS = (0.70, 0.15, 0.15)
SPLIT_SEED = 42

# Random-search space of the second boosted learner
# (kind, low, high); integer highs are exclusive, float ranges inclusive.
RANDOM_SEARCH_SPACE = {
    "n_estimators": ("int", 50, 300),
    "learning_rate": ("uniform", 0.01, 0.31),
    "max_depth": ("int", 3, 10),
    "subsample": ("uniform", 0.6, 1.0),
    "colsample_bytree": ("uniform", 0.5, 1.0),
}

# Sequential-study space of the final boosted model
# (kind, low, high); integer ranges inclusive, "log" samples log-uniformly.
STUDY_SPACE = {
    "n_estimators": ("int_incl", 100, 1000),
    "learning_rate": ("log", 1e-3, 0.1),
    "num_leaves": ("int_incl", 20, 100),
    "max_depth": ("int_incl", 3, 12),
    "min_child_samples": ("int_incl", 5, 100),
    "subsample": ("uniform", 0.6, 1.0),
    "colsample_bytree": ("uniform", 0.6, 1.0),
    "reg_alpha": ("log", 1e-8, 10.0),
    "reg_lambda": ("log", 1e-8, 10.0),
    "min_split_gain": ("log", 1e-8, 1.0),
}

# The two TF-IDF blocks of the rating model.
TFIDF_BLOCKS = [
    {"ngram_range": (1, 2), "min_df": 5, "max_df": 0.9, "max_terms": 2000, "token_min_len": 1},
    {"ngram_range": (1, 3), "min_df": 10, "max_df": 0.8, "max_terms": 1000, "token_min_len": 2},
]
