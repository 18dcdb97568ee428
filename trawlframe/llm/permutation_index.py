"""Nearest neighbours by a permutation index: pivots, inverted files, footrule, rerank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Pivots are taken from at most so many vectors, those with the smallest hash of the id.
PIVOT_SAMPLE = 4096
PIVOTS, POSTED, PROBED, KEPT_SHARE, KEPT_LEAST = 64, 6, 24, 0.4, 32
# Postings of one list, and queries, that meet in one group.
LIST_BLOCK, QUERY_BLOCK = 2048, 2048


def usable(vector: Column) -> Column:
    """True for a vector that is not null, empty or zero and holds finite numbers alone."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def far_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Unit vectors of the sample, each the least like those before it; copies come last."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _unpacked(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _search_block(key, index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one block of a pivot's list for each query that probes the list."""
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    if not len(index) or not len(queries):
        return empty
    index = index.drop_duplicates().sort_values("vec_id", kind="stable")
    ids, vectors, places = (index["vec_id"].to_numpy(np.int64), _unpacked(index["vector"], np.float64),
                            _unpacked(index["places"], np.int16))
    norms = np.sqrt(np.square(vectors).sum(axis=1))
    asked, wanted = _unpacked(queries["vector"], np.float64), _unpacked(queries["places"], np.int16)
    # A vector stands in several lists; it is met in the first of its lists that the query probes.
    earlier = places < places[:, [key[0]]]
    met_before = earlier.astype(np.float32) @ (wanted < PROBED).T.astype(np.float32) > 0
    out = []
    for j, query_id in enumerate(queries["query_id"].to_numpy(np.int64)):
        rows = np.flatnonzero(~met_before[:, j] & (ids != query_id))
        if not len(rows):
            continue
        footrule = np.abs(places[rows] - wanted[j]).sum(axis=1, dtype=np.int64)
        keep = max(KEPT_LEAST, int(np.ceil(KEPT_SHARE * len(rows))))
        rows = rows[np.argsort(footrule, kind="stable")[:keep]]
        norm = np.sqrt(np.square(asked[j]).sum())
        scores = (vectors[rows] * asked[j]).sum(axis=1) / (norms[rows] * norm)
        best = np.lexsort((ids[rows], -scores))[:k]
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows[best]], "score": scores[best]}))
    return pd.concat(out) if out else empty


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id",
                       vector_column: str = "embedding") -> DataFrame:
    """The k nearest rows of ``vectors`` by cosine for each row of ``queries``.

    PIVOTS far vectors of a bounded sample stand for places. Every vector is
    represented by the order in which it sees them and posted in the lists of its
    POSTED nearest pivots; a query probes the lists of its PROBED nearest, ranks
    what it meets by footrule distance of the two orders, reranks the best
    KEPT_SHARE (at least KEPT_LEAST of each list) by exact cosine in double
    precision, and keeps k, ties to the smaller id. Lists are cut in blocks by a
    hash of the id, and queries in blocks too, so neither a crowded pivot nor a long
    query set meets in one task.

    Returns query_id, rank from 1, vec_id, score. A query's own id is no candidate;
    equal rows count once. Rows with a null id, or whose vector is null, empty, zero,
    of another than the commonest dimension, or holds null or non-finite numbers,
    take no part. Other columns are ignored. Up to POSTED + 1 vectors, all are found.
    """
    spark = vectors.sparkSession
    typed = F.col(vector_column).cast("array<double>")

    def clean(df: DataFrame) -> DataFrame:
        return (df.select(F.col(id_column).cast("long").alias("vec_id"), typed.alias("v"))
                .where(F.col("vec_id").isNotNull() & usable(F.col("v"))))

    known = clean(vectors)
    sizes = known.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dimension, total = sizes
    known = known.where(F.size("v") == dimension)
    asked = clean(queries).where(F.size("v") == dimension)
    n_queries = asked.count()
    sample = known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    pivots = far_pivots(np.array([r["v"] for r in sample]))
    posted = min(POSTED, len(pivots))
    probed = min(PROBED, len(pivots))
    blocks = -(-total * posted // (len(pivots) * LIST_BLOCK))
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))

    @F.pandas_udf("vector binary, places binary, nearest array<int>")
    def represent(v: pd.Series) -> pd.DataFrame:
        x = np.vstack(v.to_numpy()) if len(v) else np.empty((0, dimension))
        order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
        places = np.empty(order.shape, np.int16)
        np.put_along_axis(places, order, np.arange(len(pivots), dtype=np.int16)[None].repeat(len(x), 0), 1)
        return pd.DataFrame({"vector": [r.tobytes() for r in x], "places": [r.tobytes() for r in places],
                             "nearest": [r.astype(np.int32) for r in order[:, :max(posted, probed)]]})

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = (known.withColumn("r", represent("v"))
             .select("vec_id", "r.vector", "r.places", F.explode(F.slice("r.nearest", 1, posted)).alias("pivot"))
             .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("part", spread(query_blocks)))
    probes = (asked.withColumn("r", represent("v"))
              .groupBy(F.col("vec_id").alias("query_id")).agg(F.min("r").alias("r"))
              .select("query_id", "r.vector", "r.places", F.explode(F.slice("r.nearest", 1, probed)).alias("pivot"))
              .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
              .withColumn("block", spread(blocks)))

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search_block(key, left[["vec_id", "vector", "places"]], right, k)

    keys = ["pivot", "block", "part"]
    found = (index.groupBy(*keys).cogroup(probes.groupBy(*keys))
             .applyInPandas(search, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
