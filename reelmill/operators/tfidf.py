"""Term statistics, vocabulary and TF-IDF.

Documents are partitioned by id first, so that all texts of an id meet. A vocabulary is fitted, and
documents are weighed by one, on n-grams as numbers (``grams.py``). ``term_counts`` gives all terms
of all documents as rows, for those who want them: they are several times larger than the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelmill.functions.text import ngrams, tokens
from reelmill.operators import grams
from reelmill.session import spread, store, stored_side

# Terms that are ranked in one window at most; more are cut down by their prefixes first.
RANKED = 100_000


def term_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "clean_text",
    ngram_range: tuple[int, int] = (1, 3),
    raw: bool = False,
    keep: tuple[str, ...] = (),
    partitioned: bool = False,
) -> DataFrame:
    """(doc_id, [kept columns], term, tf). Kept columns must depend on the id alone.

    Each document also gets the empty term once, so that the number of documents, those without
    terms included, is among the counts. ``partitioned``: docs are already spread by ``doc_id``.
    """
    docs = docs.select(doc_id, *keep, text)
    if not partitioned:
        docs = spread(docs, doc_id)
    # generators of one row keep the optimizer from evaluating the words once per use
    words = docs.select(doc_id, *keep, F.explode(F.array(tokens(F.col(text), raw))).alias("words"))
    grams = F.concat(F.array(F.lit("")), ngrams(F.col("words"), *ngram_range))
    terms = words.select(doc_id, *keep, F.explode(grams).alias("term")).filter(F.col("term").isNotNull())
    return terms.groupBy(doc_id, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_statistics(counts: DataFrame) -> DataFrame:
    """(term, df, ctf): documents with the term, and its occurrences in all."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))


def cap_terms(stats: DataFrame, max_features: int) -> DataFrame:
    """The ``max_features`` terms with the highest ``ctf``; ties by term.

    A limit over all terms would collect max_features rows from every partition in one task. Instead
    the counts themselves are counted: a corpus of T tokens has fewer than sqrt(2T) different
    values of ``ctf``, so the table that is summed up in one task stays small, and only terms that
    tie at the threshold are ranked.
    """
    levels = stats.groupBy("ctf").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(W.partitionBy().orderBy(F.desc("ctf"))) - F.col("n")
    edge = levels.withColumn("above", above).filter(F.col("above") < max_features)
    # ctf of the last level that still has a place, and how many places that level gets
    last = edge.agg(F.min_by(F.struct("ctf", "above"), "ctf").alias("e")).select("e.*")
    threshold, taken = last.select("ctf").scalar(), last.select("above").scalar()
    over = stats.filter(F.col("ctf") > threshold)
    tied = stats.filter(F.col("ctf") == threshold)
    places = max_features - last.first()["above"]
    return over.unionByName(first_terms(tied, places))


def first_terms(terms: DataFrame, n: int) -> DataFrame:
    """The first ``n`` terms in alphabetical order.

    Terms are counted by prefix; whole prefixes are taken while they fit, and the one that the cut
    falls into is looked at again with a longer prefix, until few enough terms are left to rank.
    """
    taken, length, rest = [], 2, terms
    while n > 0:
        by = F.substring("term", 1, length)
        counts = rest.groupBy(by.alias("p")).agg(F.count(F.lit(1)).alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy().orderBy("p")))
        border = upto.filter(F.col("upto") > n).orderBy("p").limit(1).collect()
        if not border:
            taken.append(rest)
            break
        edge = border[0]
        taken.append(rest.filter(by < edge["p"]))
        n -= edge["upto"] - edge["n"]
        rest = rest.filter(by == edge["p"])
        if edge["n"] <= RANKED:
            place = F.row_number().over(W.partitionBy().orderBy("term"))
            taken.append(rest.withColumn("_r", place).filter(F.col("_r") <= n).drop("_r"))
            break
        length += 2
    out = terms.limit(0)
    for part in taken:
        out = out.unionByName(part)
    return out


def numbered(terms: DataFrame) -> DataFrame:
    """Add ``term_id`` from 0 in alphabetical order: sorted ranges are numbered each, then shifted."""
    n = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = terms.repartitionByRange(n, "term").sortWithinPartitions("term").withColumn("_at", F.monotonically_increasing_id())
    ranged = store(ranged, "terms").withColumn("_part", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    base = F.sum("n").over(W.partitionBy().orderBy("_part")) - F.col("n")  # one row per range
    placed = ranged.join(F.broadcast(sizes.select("_part", base.alias("_base"))), "_part")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("term_id", (F.col("_base") + within).cast("int")).drop("_at", "_part", "_base")


def fit_tfidf(counts: DataFrame, max_features: int | None = 50_000, min_df: int = 3, max_df: float = 0.9) -> DataFrame:
    """(term, term_id, df, ctf, idf) from term counts; ``max_features=None`` keeps every term.

    The texts are read once: frequent enough terms are stored and capped, numbered and weighed from
    there.
    """
    stats = store(term_statistics(counts).filter((F.col("df") >= min_df) | (F.col("term") == "")), "statistics")
    marker = stats.filter(F.col("term") == "").first()
    n = marker["df"] if marker else 0
    terms = stats.filter((F.col("term") != "") & (F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    chosen = terms if max_features is None or terms.count() <= max_features else cap_terms(terms, max_features)
    return _vocabulary(chosen, n)


def _vocabulary(chosen: DataFrame, n: int) -> DataFrame:
    idf = F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1
    return store(numbered(chosen).select("term", "term_id", "df", "ctf", idf.alias("idf")), "vocabulary")


def fit_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "clean_text",
    ngram_range: tuple[int, int] = (1, 3),
    raw: bool = False,
    max_features: int | None = 50_000,
    min_df: int = 3,
    max_df: float = 0.9,
) -> DataFrame:
    """``fit_tfidf`` from the documents themselves, without a row for each of their terms.

    N-grams are counted by hash first. Those that can be in the vocabulary, all that tie at the cap
    included, get their text from a second reading, and are capped by it.
    """
    lists = store(grams.word_lists(docs, doc_id, text, raw).select("texts"), "words")
    hashed = store(grams.hashed_statistics(lists, *ngram_range, min_df), "statistics")
    n = hashed.filter("h1 is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    wanted = hashed.filter(F.col("h1").isNotNull() & (F.col("df") <= max_df * n))
    capped = max_features is not None and wanted.count() > max_features
    if capped:
        levels = wanted.groupBy("ctf").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(W.partitionBy().orderBy(F.desc("ctf"))) - F.col("n")
        wanted = wanted.filter(F.col("ctf") >= levels.withColumn("above", above).filter(F.col("above") < max_features).agg(F.min("ctf")).first()[0])
    terms = store(grams.named_terms(lists, wanted, *ngram_range), "terms")
    return _vocabulary(cap_terms(terms, max_features) if capped else terms, n)


def weigh(counts: DataFrame, vocab: DataFrame, doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, [kept], term_id, weight): (1 + ln tf) * idf, rows of length one. Unknown terms drop out.

    ``vocab`` is a stored table; it is broadcast if it is measured to be small enough.
    """
    return _weights(counts.join(stored_side(vocab.select("term", "term_id", "idf")), "term"), doc_id, keep)


def _weights(known: DataFrame, doc_id: str, keep: tuple[str, ...]) -> DataFrame:
    raw = known.select(doc_id, *keep, "term_id", ((F.log(F.col("tf")) + 1) * F.col("idf")).alias("_x"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(W.partitionBy(doc_id)))
    return raw.select(doc_id, *keep, "term_id", (F.col("_x") / norm).alias("weight"))


def transform_tfidf(
    docs: DataFrame,
    vocab: DataFrame,
    doc_id: str = "doc_id",
    text: str = "clean_text",
    ngram_range: tuple[int, int] = (1, 3),
    raw: bool = False,
    keep: tuple[str, ...] = (),
    partitioned: bool = False,
) -> DataFrame:
    """Weigh texts by a fitted vocabulary, a stored table.

    Terms are looked up as numbers where the texts are, and only known ones become rows; a vocabulary that is
    too large to be sent is joined with the rows of all terms.
    """
    if vocab.count() > grams.SENT:
        return weigh(term_counts(docs, doc_id, text, ngram_range, raw, keep, partitioned), vocab, doc_id, keep)
    lists = grams.word_lists(docs, doc_id, text, raw, keep, partitioned)
    found = grams.known_terms(lists, vocab, *ngram_range).select(doc_id, *keep, F.explode(F.arrays_zip("idx", "tf")).alias("e"))
    counts = found.select(doc_id, *keep, F.col("e.idx").alias("term_id"), F.col("e.tf").alias("tf"))
    return _weights(counts.join(stored_side(vocab.select("term_id", "idf")), "term_id"), doc_id, keep)
