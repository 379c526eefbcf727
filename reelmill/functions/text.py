"""Text expressions. All of them stay inside the JVM; none is a Python function over rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelmill.params import NEGATIVE_PHRASES, POSITIVE_PHRASES, STOP_WORDS

# White space as Unicode defines it, so that an address ends where a reader sees it end. Spelled
# out because Java's \s is ASCII only.
UNICODE_SPACE = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
TAG = r"<[^>\n]*>"
ADDRESS = rf"https?://[^{UNICODE_SPACE}]+"
WORD = r"\b[a-zA-Z'][a-zA-Z']+\b"


def collapse_phrases(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replace each phrase by its single token, as a substring, in list order."""
    for phrase, token in pairs:
        text = F.replace(text, F.lit(phrase), F.lit(token))
    return text


def clean_text(text: Column) -> Column:
    """Lower-case, drop tags and addresses, collapse phrases, keep letters and apostrophes."""
    text = F.lower(text)
    text = F.regexp_replace(text, TAG, " ")
    text = F.regexp_replace(text, ADDRESS, " ")
    text = collapse_phrases(text, POSITIVE_PHRASES)
    text = collapse_phrases(text, NEGATIVE_PHRASES)
    # The words are taken out: looking for what lies between them takes ten times as long.
    return F.array_join(F.regexp_extract_all(text, F.lit(r"[a-zA-Z']+"), F.lit(0)), " ")


def word_count(clean: Column) -> Column:
    """Words of an already cleaned text; the empty text has none."""
    return F.size(F.array_remove(F.split(clean, " "), ""))


def normalize_title(title: Column, roman_fix: bool = False) -> Column:
    """Key under which titles are matched.

    The numeral step looks for capitals after lower-casing and so never fires; ``roman_fix``
    makes it look for lower-case numerals instead.
    """
    key = F.regexp_replace(F.lower(title), r"\(\d{4}\)", "")
    key = F.regexp_replace(key, r"\([ivx]+\)" if roman_fix else r"\([IVX]+\)", "")
    return F.regexp_replace(key, r"[^a-z0-9]", "")


def ascii_words(text: Column) -> Column:
    """Prepare raw text for the ASCII word pattern.

    Other letters and digits become ``0`` (part of a word, but of no token), other signs become
    blanks. Word borders then fall where Unicode puts them, on every Java version.
    """
    text = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x{00}-\x{7f}]", " ")
    return F.regexp_replace(text, r"[^\x{00}-\x{7f}]", "0")


def tokens(text: Column, raw: bool = False, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words of two or more letters or apostrophes, stop words removed. ``raw``: not cleaned yet."""
    words = F.regexp_extract_all(ascii_words(text) if raw else text, F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop_words))


def ngrams(words: Column, low: int = 1, high: int = 3) -> Column:
    """All n-grams for low <= n <= high, joined by one blank. Lists end in nulls where words do."""

    def starting_at(word: Column, i: Column) -> Column:
        grams, gram = [], word
        for n in range(1, high + 1):
            if n > 1:
                gram = F.concat(gram, F.lit(" "), F.get(words, i + (n - 1)))
            if n >= low:
                grams.append(gram)
        return F.array(*grams)

    return F.flatten(F.transform(words, starting_at))
