"""Candidate pools, personal scores, blending and diversity re-ranking, for many queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.functions.scoring import blend
from reelmill.operators.factors import dot
from reelmill.operators.ranking import minmax, top_k
from reelmill.operators.similarity import DIGITS, Places, meet_vectors, taste_vectors, top_cosine
from reelmill.session import small_side

GUEST, ACCOUNT, USER = "guest", "account", "user"


def query_pool(query_vectors: DataFrame, item_vectors: DataFrame, n: int) -> DataFrame:
    """The max(150, 15 n) items closest to each query, of those with any similarity."""
    return top_cosine(query_vectors, item_vectors, max(150, 15 * n), "query_id", "item").drop("rank")


def seed_pool(seeds: DataFrame, seed_vectors: DataFrame, item_vectors: DataFrame, n: int, exclude_seeds: bool = True) -> DataFrame:
    """The max(200, 20 n) items closest to each seed set, seeds themselves left out.

    Each set asks for as many more items as it has seeds, so that leaving them out loses nothing.
    """
    size = max(200, 20 * n)
    if not exclude_seeds:
        return top_cosine(seed_vectors, item_vectors, size, "query_id", "item", in_place=True).drop("rank")
    chosen = seeds.select("query_id", "item").distinct()
    counts = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_seeds"))
    asking = seed_vectors.join(small_side(counts), "query_id")  # vectors are wide; they stay where they are made
    found = top_cosine(asking, item_vectors, F.lit(size) + F.col("n_seeds"), "query_id", "item", in_place=True).drop("rank")
    rest = found.join(chosen, ["query_id", "item"], "left_anti")
    return top_k(rest, ["query_id"], [F.desc("cos"), F.asc("item")], size).drop("rank")


def personalize(
    queries: DataFrame,
    user_factors: DataFrame | None = None,
    favourites: DataFrame | None = None,
    item_vectors: DataFrame | None = None,
) -> DataFrame | None:
    """(query_id, factors, idx, val, norm) for the queries that have a personal side.

    ``queries`` holds (query_id, user, kind): a named ``user`` counts if it has factors, an
    ``account`` if it has favourites (user, item, rating); guests never do.
    """
    parts = []
    empty = {"factors": "array<double>", "idx": "array<int>", "val": "array<double>", "norm": "double"}

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(
            "query_id", *[(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)) for c, t in empty.items()]
        )

    if user_factors is not None:
        named = queries.filter(F.col("kind") == USER).select("query_id", "user")
        parts.append(shaped(named.join(user_factors, "user")))
    if favourites is not None and item_vectors is not None:
        accounts = queries.filter(F.col("kind") == ACCOUNT).select("query_id", "user")
        owners = accounts.select("user").distinct()
        liked = favourites.join(owners, "user", "left_semi")
        tastes = taste_vectors(liked, item_vectors, "user")
        liking = accounts.join(liked.select("user").distinct(), "user", "left_semi")
        parts.append(shaped(liking.join(tastes, "user", "left")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def personal_scores(pool: DataFrame, personal: DataFrame | None, item_vectors: DataFrame, item_factors: DataFrame | None) -> DataFrame:
    """Add ``is_pers`` and ``pers_raw``: u . v of factors, or taste cosine; zero if unknown."""
    if personal is None:
        return pool.withColumn("is_pers", F.lit(False)).withColumn("pers_raw", F.lit(0.0))
    asks = personal.select("query_id", F.lit(True).alias("is_pers"), F.col("factors").alias("_u"), F.col("idx").isNotNull().alias("_taste"))
    joined = pool.join(asks, "query_id", "left").withColumn("is_pers", F.coalesce("is_pers", F.lit(False)))
    score = F.lit(0.0)
    if item_factors is not None:
        f = item_factors.select(F.col("item").alias("_fi"), F.col("factors").alias("_f"))
        joined = joined.join(f, (F.col("item") == F.col("_fi")) & F.col("_u").isNotNull(), "left")
        score = F.coalesce(dot("_u", "_f"), score)
    tastes = personal.filter("idx is not null").select("query_id", "idx", "val", "norm")
    joined = joined.join(taste_cosines(pool, tastes, item_vectors), ["query_id", "item"], "left")
    score = F.when(F.col("_taste"), F.coalesce("_cos", F.lit(0.0))).otherwise(score)
    return joined.withColumn("pers_raw", score).select(*pool.columns, "is_pers", "pers_raw")


def taste_cosines(pool: DataFrame, tastes: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """(query_id, item, _cos) of the tastes (query_id, idx, val, norm) with the items of their pools.

    Pools are cut into slices by query; each gets its queries' tastes and the item vectors that it
    needs once, and multiplies them there.
    """
    wanted = pool.select("query_id", "item").join(tastes.select("query_id"), "query_id", "left_semi").distinct()
    lists = wanted.withColumn("_head", F.row_number().over(W.partitionBy("query_id").orderBy("item")) == 1)
    # A taste travels with the first row of its query.
    taste = tastes.select("query_id", F.lit(True).alias("_head"), F.col("idx").alias("_ti"), F.col("val").alias("_tv"), F.col("norm").alias("_tn"))
    rows = lists.join(taste, ["query_id", "_head"], "left")
    kinds = [T.StructField(c, pool.schema[c].dataType) for c in ("query_id", "item")]

    def multiply(rows: pd.DataFrame, place: dict, idx: list, val: list, norm: np.ndarray):
        for query, mine in rows.groupby("query_id", sort=False):
            first = mine[mine["_head"]].iloc[0]
            known = [(i, place[i]) for i in mine["item"] if i in place]
            theirs, values = np.asarray(first["_ti"]), np.asarray(first["_tv"])
            width = max([int(theirs[-1]) if len(theirs) else 0, *(int(idx[s][-1]) for _, s in known if len(idx[s]))]) + 1
            row = np.zeros(width)
            row[theirs] = values
            for item, spot in known:
                length = first["_tn"] * norm[spot]
                yield query, item, float(np.round(val[spot] @ row[idx[spot]] / length, DIGITS)) if length > 0 else 0.0

    schema = T.StructType([*kinds, T.StructField("_cos", T.DoubleType())])
    return meet_vectors(rows, item_vectors, ("query_id",), "item", schema, multiply)


def blend_scores(scored: DataFrame, w_cos: float = 0.6) -> DataFrame:
    """Scale both scores per query and blend them into ``final``."""
    scaled = minmax(minmax(scored, "cos", ["query_id"], "cos_norm"), "pers_raw", ["query_id"], "pers_norm")
    mixed = blend(F.col("cos_norm"), F.col("pers_norm"), F.col("is_pers"), w_cos)
    return scaled.withColumn("final", F.round(mixed, 9))


def mmr_rerank(
    candidates: DataFrame,
    item_vectors: DataFrame,
    n: int,
    lmbda: float = 0.6,
    query: str = "query_id",
    item: str = "item",
    score: str = "final",
    nonnegative: bool = True,
) -> DataFrame:
    """Pick ``n`` of each query's candidates, trading relevance against similarity to the picks.

    Adds ``rank``. The first pick has no penalty; ties go to the better candidate, then the first
    item. Pools of at most ``n`` keep their order. With similarities between 0 and 1, a candidate
    whose relevance is too far behind the n-th one can never be picked: one of the n best is always
    left and loses at most 1 - lmbda. Those are dropped first. The rest, at most one pool, is
    re-ranked in one call per query. Pools are cut into slices by query, which get the item vectors
    that they need, each once, and no vector is copied for each candidate (``meet_vectors``).
    """
    w = W.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    cands = candidates.withColumn("_place", F.row_number().over(w))
    if nonnegative:
        nth = F.min(F.when(F.col("_place") <= n, F.col(score))).over(W.partitionBy(query))
        reach = F.col(score) * lmbda >= nth * lmbda - (1.0 - lmbda) - 1e-9
        cands = cands.withColumn("_reach", reach).filter((F.col("_place") <= n) | F.col("_reach")).drop("_reach")
    fields = list(candidates.schema.fields)
    names = [f.name for f in fields]

    def pick(rows: pd.DataFrame, place: Places, idx: list, val: list, norm: np.ndarray) -> pd.DataFrame:
        rows = rows.sort_values("_place", ignore_index=True)
        likeness = _Likeness(idx, val, norm)
        found = [place.every.get(i, [-1]) for i in rows[item]]  # an item with several vectors is as many candidates
        rows = rows.iloc[np.repeat(np.arange(len(rows)), [len(f) for f in found])].reset_index(drop=True)
        spots = np.array([s for f in found for s in f], np.int64)
        relevance = lmbda * rows[score].to_numpy()
        kept, ranks = [], []
        for at in rows.groupby(query, sort=False, dropna=False).indices.values():
            taken = list(range(len(at))) if len(at) <= n else choose(relevance[at], spots[at], likeness)
            kept += [at[t] for t in taken]
            ranks += range(1, len(taken) + 1)
        return rows.iloc[kept].assign(rank=np.array(ranks, np.int32))[names + ["rank"]]

    def choose(relevance: np.ndarray, spots: np.ndarray, likeness: _Likeness) -> list[int]:
        worst = np.zeros(len(spots))
        taken: list[int] = []
        free = np.ones(len(spots), bool)
        for step in range(n):
            value = np.where(free, np.round(relevance - (1.0 - lmbda) * worst, 9), -np.inf)
            best = int(np.argmax(value))
            taken.append(best)
            free[best] = False
            sims = likeness(spots, spots[best])
            worst = sims if step == 0 else np.maximum(worst, sims)
        return taken

    schema = T.StructType(fields + [T.StructField("rank", T.IntegerType())])
    return meet_vectors(cands, item_vectors, (query,), item, schema, pick, every=True)


class _Likeness:
    """Cosines of some vectors with one of them, by their places; zero for place -1 and vectors without length."""

    def __init__(self, idx: list, val: list, norm: np.ndarray):
        self.idx = [i if np.ndim(i) else np.zeros(0, np.int64) for i in idx]
        self.unit = [np.asarray(v) / m if m > 0 else np.zeros(len(i)) for i, v, m in zip(self.idx, val, norm)]
        self.row = np.zeros(max((int(i[-1]) for i in self.idx if len(i)), default=0) + 1)
        width = len(self.row)
        # vectors without gaps are rows of a matrix, the last of which stands for none
        self.matrix = np.stack([*self.unit, np.zeros(width)]) if len(idx) and all(len(i) == width for i in self.idx) else None
        self.known: dict[int, dict[int, float]] = {}

    def __call__(self, spots: np.ndarray, one: int) -> np.ndarray:
        if one < 0:
            return np.zeros(len(spots))
        if self.matrix is not None:
            return np.round(self.matrix[spots] @ self.unit[one], DIGITS)
        known = self.known.setdefault(int(one), {-1: 0.0})
        missing = [s for s in spots.tolist() if s not in known]
        if missing:
            self.row[self.idx[one]] = self.unit[one]
            for s in missing:
                known[s] = float(np.round(self.unit[s] @ self.row[self.idx[s]], DIGITS))
            self.row[self.idx[one]] = 0.0
        return np.array([known[s] for s in spots.tolist()])


def finish(
    pool: DataFrame,
    item_vectors: DataFrame,
    n: int,
    w_cos: float = 0.6,
    use_mmr: bool = True,
    lmbda: float = 0.6,
    personal: DataFrame | None = None,
    item_factors: DataFrame | None = None,
) -> DataFrame:
    """The common tail: personal score, scaling, blend, then MMR or the plain first n."""
    scored = blend_scores(personal_scores(pool, personal, item_vectors, item_factors), w_cos)
    return rank_blended(scored, item_vectors, n, use_mmr, lmbda)


def rank_blended(scored: DataFrame, item_vectors: DataFrame, n: int, use_mmr: bool = True, lmbda: float = 0.6) -> DataFrame:
    if use_mmr:
        return mmr_rerank(scored, item_vectors, n, lmbda)
    return top_k(scored, ["query_id"], [F.desc("final"), F.asc("item")], n)
