"""Run parameters, named configurations and fixed word lists."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    """Every number a run depends on. Frozen, so that it can be logged as it was used."""

    # reviews; sample_size bounds the rows that the classifier is fitted on, and nothing else
    sample_size: int | None = 500_000
    positive_from: float = 7
    negative_to: float = 4
    balance_ratio: float = 1.5
    min_words: int = 10
    max_words: int = 2000
    year_from: int = 1980
    year_to: int = 2024
    title_types: tuple[str, ...] = ("movie", "tvSeries", "tvMovie", "short")
    # text features
    max_features: int = 50_000
    min_df: int = 3
    max_df: float = 0.90
    ngram_range: tuple[int, int] = (1, 3)
    # profiles and factors
    min_item_reviews: int = 3
    svd_k: int = 150
    svd_iterations: int = 10
    svd_oversampling: int = 10
    svd_min_user_rows: int = 0
    # classifier
    svc_c: float = 1.0
    svc_max_iter: int = 100  # passes of the distributed solver, not of a coordinate descent
    folds: int = 3
    test_fraction: float = 0.2
    # evaluation
    eval_ks: tuple[int, ...] = (5, 10)
    eval_min_ratings: int = 3
    eval_users: int | None = None  # all; the published reports use a sample of 200
    # serving
    w_cos: float = 0.6
    mmr_lambda: float = 0.6
    snippet: int = 150
    seed: int = 42


FIRST = Params()

SECOND = replace(
    FIRST,
    sample_size=750_000,
    min_item_reviews=2,
    max_features=60_000,
    svd_k=500,
    svd_iterations=15,
    svd_min_user_rows=3,
    year_to=2021,
    mmr_lambda=0.5,
)

# ---------------------------------------------------------------------------
# Fixed values below: they must equal the published ones for results to match.
# ---------------------------------------------------------------------------

# Alternative column names in review files -> canonical name.
COLUMN_ALIASES = {
    "review_detail": ["review", "text", "content", "review_text", "review_content"],
    "rating": ["score", "stars", "ratings", "reviewer_rating"],
    "spoiler_tag": ["spoiler", "is_spoiler", "spoilers"],
}

# Phrases that become one token, replaced as plain substrings in this order.
POSITIVE_PHRASES = [
    ("must see", "mustsee"),
    ("must watch", "mustwatch"),
    ("highly recommend", "highlyrecommend"),
    ("well done", "welldone"),
    ("beautifully shot", "beautifullyshot"),
    ("edge of my seat", "edgeofmyseat"),
    ("stands out", "standsout"),
    ("life changing", "lifechanging"),
]
NEGATIVE_PHRASES = [
    ("waste of time", "wasteoftimefilm"),
    ("waste of money", "wasteofmoneyfilm"),
    ("fell asleep", "fellasleepfilm"),
    ("walked out", "walkedoutfilm"),
    ("not worth", "notworthfilm"),
    ("poorly written", "poorlywritten"),
    ("too long", "toolongfilm"),
    ("bad acting", "badactingfilm"),
]

# The widely published English stop-word list of 179 words.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
    "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the",
    "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain",
    "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't",
    "wouldn", "wouldn't",
)

# Negations carry sentiment and are therefore kept as terms.
NEGATIONS = (
    "not", "no", "nor", "n't", "don't", "isn't", "aren't", "couldn't", "didn't", "doesn't", "hadn't",
    "hasn't", "haven't", "shouldn't", "won't", "wouldn't", "never", "hardly", "nothing", "nowhere", "neither",
    "nobody", "none",
)

STOP_WORDS = [w for w in ENGLISH_STOP_WORDS if w not in NEGATIONS]

# Words too general to be shown as keywords.
GENERIC_TERMS = (
    "film", "movie", "story", "scene", "character", "plot", "time", "watch", "great", "good", "best",
    "little", "just", "like", "make", "really", "made", "one", "also", "even", "first", "well", "much",
    "think", "many", "people", "way", "year", "show", "series", "part", "get", "see", "know", "going", "come",
    "give", "take", "would", "could", "never", "still", "another", "pretty", "quite", "better",
)
