"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms describe a text: its characters by kind, and its words by which of its language's
most common words they are. The references of a language are the median histograms of all its
documents that pass the base rules. A text is rejected if the Jensen-Shannon distance (base 2, square
root) to a reference is above a limit, which is higher for shorter texts: their histograms stray
further by chance. Guards: a text with fewer characters or words than a histogram needs is not judged
by it, nor are the words of a language without a word list.

Texts are read once: the histograms are stored, and references and verdicts come from them.

Defined results: a null text has no words and fails the base rules; a null lang is a language of its
own without a word list; a language without any passing document has no reference and rejects
nothing beyond the base rules; repeated rows are judged each; other columns are ignored; an empty
table gives an empty one. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.batches import other_name
from reelmill.session import small_side, store

#: Blanks, symbols, and common words of each language.
BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
COMMON = {
    "en": "the of and to in a is that for it was on with as be at by this are or from".split(),
    "fr": "le la les de des du et en un une est que qui dans pour sur par au avec pas".split(),
    "de": "der die das und ist in den von zu mit sich auf für als auch dem des ein eine nicht".split(),
    "es": "el la los las de que y en un una es se por con para del al su no lo".split(),
}
#: Character kinds in the order in which they are taken out of a text; blanks first, the rest last.
KINDS = {"small": "[a-z]", "beyond": r"[^\x00-\x7F]", "capital": "[A-Z]", "digit": "[0-9]", "symbol": SYMBOLS}
#: Limits of the distances at n words: first + second / sqrt(n).
KIND_LIMIT, WORD_LIMIT = (0.16, 0.85), (0.21, 1.25)
LEAST_CHARACTERS, LEAST_WORDS = 200, 50
TRIMMED = ".,;:!?"
#: Steps from 0 to 1 to which shares are rounded for the medians.
STEPS = 10_000


def step(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add columns through a one-row generator, so that later uses do not compute them again."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def word_counts(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Base counts and histograms (``kinds``, ``commons``) of every text; ``extra`` columns are kept."""
    keep = ["doc_id", *extra]
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("_lang"))
    rows = step(
        rows, [*keep, "text", "_lang"],
        _w=F.filter(F.split("text", BLANK + "+"), lambda w: w != ""),
        _lines=F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        _left=F.regexp_replace("text", BLANK + "+", ""), _chars=F.length("text"),
    )
    rows = rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    rows = rows.withColumn("word_chars", F.length("_left").cast("long"))
    keep = [*keep, "_lang", "n_words", "n_dup_lines", "word_chars"]
    rows = rows.select(*keep, "_w", "_left", (F.col("_chars") - F.col("word_chars")).alias("_blank"))
    # What is left of the text gets shorter with each kind.
    counts = ["_blank"]
    for kind, pattern in KINDS.items():
        rows = step(rows, [*keep, "_w", *counts, F.length("_left").alias("_before")], _left=F.regexp_replace("_left", pattern + "+", ""))
        rows = rows.select(*keep, "_w", *counts, (F.col("_before") - F.length("_left")).alias(f"_{kind}"), "_left")
        counts.append(f"_{kind}")
    kinds = F.array(*(F.col(c).cast("double") for c in counts), F.length("_left").cast("double"))
    keep.append("n_symbols")
    rows = rows.select(*keep[:-1], F.col("_symbol").cast("long").alias("n_symbols"), kinds.alias("kinds"), "_w")

    # Common words of the text's language: their numbers, then how often each occurs.
    lists = F.create_map(*(x for lang, words in COMMON.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))))
    common = F.coalesce(F.element_at(lists, F.col("_lang")), F.array().cast("array<string>"))
    three = F.expr("if(size(_w) < 3, cast(array() as array<bigint>), transform(sequence(1, size(_w) - 2), i -> xxhash64(element_at(_w, i), element_at(_w, i + 1), element_at(_w, i + 2))))")
    rows = step(rows, [*keep, "kinds", "_w"], _common=common, _three=three)
    hits = F.expr(f"filter(transform(_w, w -> array_position(_common, trim(BOTH '{TRIMMED}' FROM lower(w)))), p -> p > 0)")
    twice = F.size("_three") > F.size(F.array_distinct("_three"))
    ranked = F.when(twice, F.sort_array(F.expr("transform(_three, (h, i) -> struct(h as h, i as i))")))
    rows = step(rows, [*keep, "kinds", F.size("_common").alias("_n")], _hits=hits, _ranked=ranked)
    commons = F.expr("if(_n = 0, null, concat(transform(sequence(1, _n), k -> cast(size(filter(_hits, p -> p = k)) as double)), array(cast(n_words - size(_hits) as double))))")
    again = F.expr("sort_array(transform(filter(_ranked, (x, k) -> (k > 0 and x.h = _ranked[k - 1].h) or (k < size(_ranked) - 1 and x.h = _ranked[k + 1].h)), x -> x.i))")
    rows = step(rows, [*keep, "kinds"], commons=commons, _again=again)
    # A repeated window covers three words, or those up to the next one.
    covered = F.expr("aggregate(transform(_again, (p, k) -> if(k = size(_again) - 1, 3, least(3, _again[k + 1] - p))), 0, (a, x) -> a + x)")
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_again")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def share(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / F.when(total > 0, total).otherwise(1))


def total_of(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def references(counted: DataFrame) -> DataFrame:
    """One row for each language: the median histograms of its documents that pass the base rules, brought to sum 1.

    Shares are rounded to ``STEPS`` steps and counted; medians come from the counts, which add up in any order.
    """
    passed = counted.where("not base_failed").select("_lang", share(F.col("kinds"), total_of(F.col("kinds"))).alias("k"), share(F.col("commons"), total_of(F.col("commons"))).alias("c"))

    def listed(kind, name):
        return F.transform(F.coalesce(name, F.array().cast("array<double>")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.round(x * STEPS).cast("int").alias("step")))

    rows = passed.select("_lang", F.explode(F.concat(listed("k", "k"), listed("c", "c"))).alias("x")).select("_lang", "x.*")
    counts = rows.groupBy("_lang", "kind", "place", "step").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("_lang", "kind", "place")  # at most STEPS + 1 rows
    counts = counts.withColumn("upto", F.sum("n").over(whole.orderBy("step"))).withColumn("all", F.sum("n").over(whole))
    middle = counts.where(2 * F.col("upto") >= F.col("all")).groupBy("_lang", "kind", "place").agg((F.min("step") / float(STEPS)).alias("m"))
    lists = middle.groupBy("_lang", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda x: x["m"]).alias("h"))
    lists = lists.withColumn("h", share(F.col("h"), total_of(F.col("h"))))
    named = [F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("h"))), F.array().cast("array<double>")).alias(name) for kind, name in (("k", "_kinds_ref"), ("c", "_commons_ref"))]
    return lists.groupBy("_lang").agg(*named)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions of the same length, 0 to 1."""

    def part(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    total = total_of(F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judge(counted: DataFrame, found: DataFrame) -> DataFrame:
    """Distances and ``kept``. The references are one row for each language, measured before they are broadcast."""
    rows = counted.join(small_side(found), "_lang", "left")
    chars = total_of(F.col("kinds"))
    kind = F.when(chars >= LEAST_CHARACTERS, distance(share(F.col("kinds"), chars), F.col("_kinds_ref")))
    words = total_of(F.col("commons"))
    common = F.when(words >= LEAST_WORDS, distance(share(F.col("commons"), words), F.col("_commons_ref")))
    rows = rows.withColumn("kind_distance", kind).withColumn("word_distance", common)
    n = F.sqrt(F.greatest("n_words", F.lit(1)))
    far = [F.coalesce(F.col(c) > first + second / n, F.lit(False)) for c, (first, second) in (("kind_distance", KIND_LIMIT), ("word_distance", WORD_LIMIT))]
    return rows.withColumn("kept", ~(F.col("base_failed") | reduce(lambda a, b: a | b, far)))


def rules(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Counts, distances and verdict of every text."""
    counted = store(word_counts(docs, extra), "histograms")
    rows = judge(counted, references(counted))
    return rows.select("doc_id", *extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kind_distance", "word_distance")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep.

    Verdicts go back to the texts by the text's digest and lang, which decide them: the rejected ones
    are broadcast if they are measured to be few, else joined.
    """
    key = other_name("_key", [*docs.columns, "_lang"])
    keyed = docs.withColumn(key, F.md5(F.concat_ws(" ", F.coalesce("lang", F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")))
    rejected = rules(keyed.select("doc_id", "text", "lang", key), (key,)).where("not kept").select(key).distinct()
    return keyed.join(small_side(rejected), key, "left_anti").select(*docs.columns)
