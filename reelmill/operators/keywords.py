"""Keywords of item sets and explanations of results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.operators.similarity import RIGHT_BLOCK, entries_of, mean_vectors, unpack_vectors
from reelmill.params import GENERIC_TERMS
from reelmill.session import small_side, stored_side


# Terms whose kinds, two bits each, are sent to every executor; a larger vocabulary is joined.
KINDS_SENT = 64 << 20
KIND_BLOCK = 1 << 16  # terms that are packed together: 16 KB


def keywords(members: DataFrame, item_vectors: DataFrame, vocab: DataFrame, group: str, n: int = 12) -> DataFrame:
    """(group, term, weight, rank): the strongest terms of each group's mean vector.

    floor(0.6 n) n-grams and, for the rest, single words that are not generic; merged by weight.
    While the vocabulary is measured to be small enough, the kinds of all terms go to the executors
    and each vector yields its n terms where it lies; otherwise the vectors' terms are joined with it.
    """
    gram = F.when(F.instr("term", " ") > 0, 1).when(F.col("term").isin(*GENERIC_TERMS), 2).otherwise(0)
    kinds = vocab.select("term_id", gram.cast("tinyint").alias("kind"))
    n_grams = int(n * 0.6)
    means = mean_vectors(members, item_vectors, group)
    top = vocab.agg(F.max("term_id").alias("m")).first()["m"]
    if top is not None and top < KINDS_SENT:
        found = _strongest_in_place(means, kinds, group, top + 1, n, n_grams)
    else:
        found = _strongest_by_join(means, kinds, group, n, n_grams)
    return found.join(stored_side(vocab.select("term_id", "term")), "term_id").select(group, "term", "weight", "rank")


def packed_kinds(kinds: DataFrame, size: int) -> np.ndarray:
    """Kinds of term ids 0 to size - 1, four in a byte; ids without a row have kind 2.

    Executors pack a range of ids each; blocks of bytes come to the driver, never a row per term.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.full(KIND_BLOCK, 2, np.uint8)
        codes[pdf["term_id"].to_numpy() % KIND_BLOCK] = pdf["kind"]
        bits = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
        return pd.DataFrame({"b": [pdf["term_id"].iloc[0] // KIND_BLOCK], "bits": [bits.sum(axis=1, dtype=np.uint8).tobytes()]})

    blocks = kinds.groupBy(F.expr(f"term_id div {KIND_BLOCK}")).applyInPandas(pack, "b long, bits binary").toArrow()
    out = np.full(-(-size // KIND_BLOCK) * KIND_BLOCK // 4, 0b10101010, np.uint8)
    for b, bits in zip(blocks["b"].to_pylist(), blocks["bits"].to_pylist()):
        out[b * KIND_BLOCK // 4 : (b + 1) * KIND_BLOCK // 4] = np.frombuffer(bits, np.uint8)
    return out


def kinds_of(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (table[ids >> 2] >> ((ids & 3) << 1).astype(np.uint8)) & 3


def _strongest_in_place(means: DataFrame, kinds: DataFrame, group: str, size: int, n: int, n_grams: int) -> DataFrame:
    shared = means.sparkSession.sparkContext.broadcast(packed_kinds(kinds, size))

    schema = T.StructType([means.schema[group], *(T.StructField(c, t) for c, t in (("term_id", T.IntegerType()), ("weight", T.DoubleType()), ("rank", T.IntegerType())))])

    def strongest(frames):
        for pdf in frames:
            out = []
            for g, i, v in zip(pdf[group], pdf["idx"], pdf["val"]):
                i, v = np.asarray(i), np.asarray(v)
                kind = kinds_of(shared.value, i)
                good = v > 0
                chosen = np.concatenate([p[first_places(i[p], v[p], m)] for p, m in ((np.flatnonzero(good & (kind == 1)), n_grams), (np.flatnonzero(good & (kind == 0)), n - n_grams))])
                chosen = chosen[first_places(i[chosen], v[chosen], n)]
                out += [(g, int(i[c]), float(v[c]), r) for r, c in enumerate(chosen, 1)]
            yield pd.DataFrame(out, columns=schema.names)

    # not a column function: rows would wait in a queue, which spills, until their results are there
    return means.select(group, "idx", "val").mapInPandas(strongest, schema)


def first_places(ids: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` greatest weights, rounded to nine digits, ties by id; only those that can be among them are sorted."""
    at = np.arange(len(ids))
    if 0 < n < len(ids):
        at = np.flatnonzero(weights >= np.partition(weights, len(ids) - n)[len(ids) - n] - 1e-8)
    return at[np.lexsort((ids[at], -np.round(weights[at], 9)))[:n]]


def _strongest_by_join(means: DataFrame, kinds: DataFrame, group: str, n: int, n_grams: int) -> DataFrame:
    """The same with one row per group and term; limits of a kind are taken before rows move to their group."""
    terms = unpack_vectors(means, group).filter("weight > 0").join(kinds.filter("kind < 2"), "term_id")
    order = [F.desc(F.round("weight", 9)), F.asc("term_id")]
    place = F.row_number().over(W.partitionBy(group, "kind").orderBy(*order))
    kept = terms.withColumn("_p", place).filter(F.col("_p") <= F.when(F.col("kind") == 1, n_grams).otherwise(n - n_grams))
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return kept.select(group, "term_id", "weight", rank.alias("rank"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("term_id", T.IntegerType()), T.StructField("weight", T.DoubleType())])))
def shared_terms(
    idx_a: pd.Series, val_a: pd.Series, idx_b: pd.Series, val_b: pd.Series, skip: pd.Series, n: pd.Series
) -> pd.Series:
    """The terms two packed vectors share, by the smaller of both weights; ids in ``skip`` left out."""

    def one(ia, va, ib, vb, out, limit):
        if ia is None or ib is None:
            return []
        ids, a, b = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
        low = np.minimum(va[a], vb[b])
        good = (low > 0) & ~np.isin(ids, out)
        ids, low = ids[good], low[good]
        best = first_places(ids, low, limit)
        return [{"term_id": int(t), "weight": float(w)} for t, w in zip(ids[best], low[best])]

    return pd.Series([one(*row) for row in zip(idx_a, val_a, idx_b, val_b, skip, n)])


def explain(
    results: DataFrame, query_vectors: DataFrame, item_vectors: DataFrame, vocab: DataFrame, query: str = "query_id", n: int = 4
) -> DataFrame:
    """(query, item, term, weight, rank): why an item matches its query.

    Term ids are alphabetical, so that ties fall to the first term. Item vectors that are measured to fit
    one block go to the executors, and lists of a query's items to its vector, so that no vector moves or is copied.
    """
    generic = vocab.filter(F.col("term").isin(*GENERIC_TERMS)).agg(F.collect_list("term_id").alias("g"))
    if entries_of(item_vectors) <= RIGHT_BLOCK:
        found = _explain_in_place(results, query_vectors, item_vectors, generic.first()["g"], query, n)
    else:
        q = query_vectors.select(query, F.col("idx").alias("_qi"), F.col("val").alias("_qv"))
        i = item_vectors.select("item", F.col("idx").alias("_ii"), F.col("val").alias("_iv"))
        joined = results.select(query, "item").join(q, query).join(i, "item")
        shared = shared_terms("_qi", "_qv", "_ii", "_iv", generic.scalar(), F.lit(n))
        found = joined.select(query, "item", F.posexplode(shared).alias("_pos", "e"))
        found = found.select(query, "item", "e.term_id", "e.weight", (F.col("_pos") + 1).alias("rank"))
    return found.join(stored_side(vocab.select("term_id", "term")), "term_id").select(query, "item", "term", "weight", "rank")


def _explain_in_place(results: DataFrame, query_vectors: DataFrame, item_vectors: DataFrame, generic: list[int], query: str, n: int) -> DataFrame:
    kind = item_vectors.schema["item"].dataType
    vectors = item_vectors.select("item", "idx", "val").toArrow().to_pandas()
    shared = results.sparkSession.sparkContext.broadcast({k: (i, v) for k, i, v in zip(vectors["item"], vectors["idx"], vectors["val"])})
    wanted = results.select(query, F.col("item").cast(kind).alias("item")).groupBy(query).agg(F.collect_list("item").alias("_items"))
    asked = query_vectors.select(query, "idx", "val").join(small_side(wanted), query)
    types = (("item", kind), ("term_id", T.IntegerType()), ("weight", T.DoubleType()), ("rank", T.IntegerType()))
    schema = T.StructType([query_vectors.schema[query], *(T.StructField(c, t) for c, t in types)])

    def explained(frames):
        lines: dict = {}  # an item's weights by term id, zero where it has none
        for pdf in frames:
            out = []
            for q, ids, weights, items in zip(pdf[query], pdf["idx"], pdf["val"], pdf["_items"]):
                ids, weights = np.asarray(ids), np.asarray(weights)
                for item in items:
                    if item not in shared.value:
                        continue
                    if item not in lines:
                        i, v = shared.value[item]
                        lines[item] = np.zeros(max(int(i[-1]) + 1 if len(i) else 1, 1))
                        lines[item][i] = v
                        lines[item][[g for g in generic if g < len(lines[item])]] = 0.0
                    inside = ids < len(lines[item])
                    low = np.minimum(weights[inside], lines[item][ids[inside]])
                    some = np.flatnonzero(low > 0)
                    ids_of = ids[inside][some]
                    best = first_places(ids_of, low[some], n)
                    out += [(q, item, int(ids_of[b]), float(low[some[b]]), r) for r, b in enumerate(best, 1)]
            yield pd.DataFrame(out, columns=schema.names)

    return asked.mapInPandas(explained, schema)
