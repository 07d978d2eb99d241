"""Column-level expressions.  All are native Spark expressions (no Python UDF)."""

from starlens.functions.text import (
    tokenize, word_count, char_count, regex_count, sentence_count, exclamation_count,
    question_count, avg_word_length, uppercase_ratio, strip_accents, regex_tokens,
    elite_count, ngrams, contains_flag,
)
from starlens.functions.hours import parse_hours, total_hours, hours_of_day, DAY_NAMES
from starlens.functions.dates import (
    parse_ts, weekday, tenure_years, engagement_ratio, reviews_per_year, date_part,
)

__all__ = [
    "tokenize", "word_count", "char_count", "regex_count", "sentence_count",
    "exclamation_count", "question_count", "avg_word_length", "uppercase_ratio",
    "strip_accents", "regex_tokens", "elite_count", "ngrams", "contains_flag",
    "parse_hours", "total_hours", "hours_of_day", "DAY_NAMES",
    "parse_ts", "weekday", "tenure_years", "engagement_ratio", "reviews_per_year",
    "date_part",
]
