"""Principal components of a panel with many series and few periods.

With s series and T periods (T small), the s x s covariance matrix is never
formed: its non-zero eigenvalues are those of the T x T matrix of products
between periods, which one pass over the series sums within the tasks. The
eigenvectors of the small matrix are taken in one task for each group, the scores
follow from the same sums, and the loadings are distributed sums again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.functions import safe_div
from trawlframe.operators.pairs import _matrix, _meet, _moments, pack_series
from trawlframe.operators.panel import anomaly, z_score
from trawlframe.session import attach_groups, cut_lineage, same_keys_join

# Rows of a matrix of covariances that the driver decomposes; larger ones stay in blocks.
MAX_PATTERN_ROWS = 8192
# Series of a block of that matrix.
COVARIANCE_BLOCK = 512
# Blocks along each side of a tile, which one task multiplies at once.
TILE_BLOCKS = 4


def _products(cells: DataFrame, by: list[str], t: str, series: str) -> DataFrame:
    """For each two periods, sums over the series of two products of their values:

    ``_g`` of the deviations from the series' own mean, ``_h`` of the value in the first
    period and the deviation in the second. A task multiplies the series of one Arrow
    batch at a time as a matrix, so that what is shuffled grows with the batches, not
    with series x periods squared. Missing values (NULL or NaN) take no part.
    """
    known = cells.filter(F.col("_a").isNotNull() & F.col(t).isNotNull())
    packed = known.groupBy(*by, series).agg(
        F.collect_list(F.struct(F.col(t).alias("t"), F.col("_a").alias("a"))).alias("_row"),
    ).select(*by, F.col("_row.t").alias("_t"), F.col("_row.a").alias("_a"))
    schema = T.StructType([
        *[cells.schema[c] for c in by],
        *[T.StructField(c, cells.schema[t].dataType) for c in ("_t1", "_t2")],
        *[T.StructField(c, T.DoubleType()) for c in ("_g", "_h")],
    ])

    def work(batches):
        for frame in batches:
            group = frame.groupby(by, dropna=False, sort=False).ngroup() if by else 0 * frame.index
            for rows in pd.Series(np.arange(len(frame))).groupby(np.asarray(group)).indices.values():
                own = frame.iloc[rows]
                times, place = np.unique(np.concatenate(own["_t"].to_list()), return_inverse=True)
                x = np.full((len(own), len(times)), np.nan)
                x[np.repeat(np.arange(len(own)), own["_t"].map(len)), place] = np.concatenate(own["_a"].to_list())
                seen = ~np.isnan(x)
                x[~seen] = 0.0
                mean = x.sum(axis=1) / np.maximum(seen.sum(axis=1), 1)
                deviation = np.where(seen, x - mean[:, None], 0.0)
                n = len(times)
                yield pd.DataFrame({
                    **{c: [own[c].iloc[0]] * (n * n) for c in by},
                    "_t1": np.repeat(times, n), "_t2": np.tile(times, n),
                    "_g": (deviation.T @ deviation).ravel(), "_h": (x.T @ deviation).ravel(),
                })

    return packed.mapInPandas(work, schema).groupBy(*by, "_t1", "_t2").agg(
        F.sum("_g").alias("_g"), F.sum("_h").alias("_h"))


def _eigen_of(products: DataFrame, by: list[str], t_type, components: int) -> DataFrame:
    """Leading eigenvalues of each group's period matrix; by period, what a value
    weighs in the loading (``_w``), and the score that the loadings lead to."""
    schema = T.StructType([
        *[products.schema[c] for c in by],
        T.StructField("component", T.IntegerType()), T.StructField("eigenvalue", T.DoubleType()),
        T.StructField("share", T.DoubleType()), T.StructField("_t", t_type),
        T.StructField("_w", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(frame["_t1"])
        i, j = np.searchsorted(times, frame["_t1"]), np.searchsorted(times, frame["_t2"])
        g, h = np.zeros((2, len(times), len(times)))
        g[i, j], h[i, j] = frame["_g"], frame["_h"]
        values, vectors = np.linalg.eigh((g + g.T) / 2 / (len(times) - 1))
        order = np.argsort(values)[::-1][:components]
        total = np.trace(g) / (len(times) - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            weights = vectors / np.sqrt(np.maximum(values, 0.0) * (len(times) - 1))
            scores = h @ weights
        parts = [
            pd.DataFrame({
                **{c: [frame[c].iloc[0]] * len(times) for c in by},
                "component": c0 + 1, "eigenvalue": max(values[c], 0.0),
                "share": max(values[c], 0.0) / total if total > 0 else np.nan,
                "_t": times, "_w": weights[:, c], "score": scores[:, c],
            })
            for c0, c in enumerate(order)
        ]
        return pd.concat(parts)[[f.name for f in schema]]

    grouped = products.groupBy(*by) if by else products.withColumn("_one", F.lit(1)).groupBy("_one")
    return grouped.applyInPandas(work, schema)


def _components(cells: DataFrame, by, t, series, components: int, placed: int):
    """(eigenvalue table, loadings, scores) of the column ``_a``.

    Loadings and scores are worked out for the first ``placed`` components.
    """
    t_type = cells.schema[t].dataType
    eigen = cut_lineage(_eigen_of(_products(cells, by, t, series), by, t_type, components))
    shares = eigen.select(*by, "component", "eigenvalue", "share").distinct()
    placed = eigen.filter((F.col("component") <= placed) & (F.col("share") > 1e-12))
    # Weights sum to zero over the periods of a component, so the series mean drops out
    # of the loadings by itself, and the scores follow from products between periods.
    scores = placed.select(*by, "component", F.col("_t").alias(t), "score")
    # Every row meets the few components of its period.
    weights = placed.groupBy(*by, F.col("_t").alias(t)).agg(
        F.collect_list(F.struct("component", "_w")).alias("_ws"))
    spread = attach_groups(cells, weights, [*by, t]).select(
        *by, t, series, "_a", F.explode("_ws").alias("_e"))
    loadings = spread.groupBy(*by, "_e.component", series).agg(
        F.sum(F.col("_a") * F.col("_e._w")).alias("loading"))
    return shares, loadings, scores


def _oriented(loadings, scores, by, t):
    """Components turned so that they rise with time, scores standardised."""
    keys = [*by, "component"]
    trend = scores.groupBy(*keys).agg(
        F.regr_slope("score", t).alias("_slope"), F.avg("score").alias("_m"),
        F.stddev_samp("score").alias("_s"))
    trend = trend.withColumn("_sign", F.when(F.col("_slope") < 0, -1.0).otherwise(1.0))
    turned = attach_groups(loadings, trend.select(*keys, "_sign"), keys).withColumn(
        "loading", F.col("loading") * F.col("_sign")).drop("_sign")
    standard = attach_groups(scores, trend, keys).select(
        *keys, t, (F.col("_sign") * safe_div(F.col("score") - F.col("_m"), F.col("_s"))).alias("pc"))
    return turned, standard


def spatial_pca(panel: DataFrame, t: str, series: str, value: str, by: list[str] | None = None,
                components: int = 5) -> dict[str, DataFrame]:
    """PCA over series of the anomalies from each period's mean.

    The panel must be complete. Returns ``shares`` (of variance, leading
    components), ``loadings`` (first component) and ``scores`` (first
    component, standardised, rising with time).
    """
    by = list(by or [])
    # Read once for the anomalies, the products, the loadings and the scores.
    panel = cut_lineage(panel.select(*by, t, series, value))
    cells = anomaly(panel, t, value, by, out="_a").select(*by, t, series, "_a")
    shares, loadings, scores = _components(cells, by, t, series, components, placed=1)
    loadings, scores = _oriented(loadings, scores, by, t)
    return {"shares": shares, "loadings": loadings.drop("component"), "scores": scores.drop("component")}


def standardized_pca(panel: DataFrame, t: str, series: str, value: str,
                     components: int = 3) -> dict[str, DataFrame]:
    """PCA of series centred and scaled one by one (such as stratum means).

    Returns ``shares``, ``loadings`` and ``scores`` (not standardised) of the
    leading components; the sign of a component is arbitrary, so it is turned
    to make its largest loading positive.
    """
    panel = cut_lineage(panel.select(t, series, value))
    cells = z_score(panel, [series], value, "_a").select(t, series, "_a").filter(
        F.col("_a").isNotNull())
    shares, loadings, scores = _components(cells, [], t, series, components, placed=components)
    largest = loadings.groupBy("component").agg(
        F.signum(F.max_by("loading", F.struct(F.abs("loading"), F.col(series)))).alias("_sign"))
    turned = attach_groups(loadings, largest, ["component"]).withColumn(
        "loading", F.col("loading") * F.col("_sign")).drop("_sign")
    scores = attach_groups(scores, largest, ["component"]).withColumn(
        "score", F.col("score") * F.col("_sign")).drop("_sign")
    return {"shares": shares, "loadings": turned, "scores": scores}


def _pattern_products(packed: DataFrame, periods: int) -> DataFrame:
    """pattern, place, total: sums over the series of x x', one matrix for each pattern."""
    def work(batches):
        sums: dict[str, np.ndarray] = {}
        for frame in batches:
            x = _matrix(frame, periods)[0]
            for pattern, rows in frame.groupby("pattern").indices.items():
                own = x[rows].T @ x[rows]
                sums[pattern] = sums[pattern] + own if pattern in sums else own
        for pattern, total in sums.items():
            yield pd.DataFrame({"pattern": pattern, "place": np.arange(periods * periods),
                                "total": total.ravel()})

    return (packed.mapInPandas(work, "pattern string, place int, total double")
            .groupBy("pattern", "place").agg(F.sum("total").alias("total")))


def _pattern_spectrum(products: dict[str, np.ndarray], periods: int, components: int):
    """All non-zero eigenvalues, largest size first, and the leading components' weights.

    With B the values of all series, laid out by pattern and period, the covariances
    are B K B' for the coefficients K. If B'B = L L', they share their non-zero
    eigenvalues with L'K L, and an eigenvector u of that gives the loadings B w with
    w = K L u / eigenvalue.
    """
    names = sorted(products)
    masks = np.zeros((len(names), periods))
    for i, name in enumerate(names):
        masks[i, [int(k) for k in name.split(",")]] = 1.0
    size = len(names) * periods
    form, root = np.zeros((size, size)), np.zeros((size, size))
    for i, name in enumerate(names):
        at = slice(i * periods, (i + 1) * periods)
        values, vectors = np.linalg.eigh(products[name].reshape(periods, periods))
        root[at, at] = vectors * np.sqrt(np.clip(values, 0, None))
        for j in range(len(names)):
            shared = masks[i] * masks[j]
            n = shared.sum()
            if n > 1:
                form[at, j * periods:(j + 1) * periods] = (np.diag(shared) - np.outer(shared, shared) / n) / (n - 1)
    values, vectors = np.linalg.eigh(root.T @ form @ root)
    order = np.argsort(np.abs(values))[::-1]
    leading = [k for k in order[:components] if values[k] != 0]
    w = [(form @ root @ vectors[:, k] / values[k]).reshape(len(names), periods) for k in leading]
    none = np.zeros(periods)
    return values[order], {name: [x[i] for x in w] or [none] for i, name in enumerate(names)}


def _covariance_blocks(packed: DataFrame, periods: int) -> DataFrame:
    """i, j, rows, data: the covariances of all series in blocks, by series within a block."""
    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"i": [], "j": [], "rows": [], "data": []})
        cov, _, n = _moments(a.sort_values("series"), b.sort_values("series"), periods)
        data = np.where(n > 1, cov / np.maximum(n - 1, 1), 0.0)
        return pd.DataFrame({"i": [a["_i"].iloc[0]], "j": [a["_j"].iloc[0]], "rows": [len(a)],
                             "data": [data.tobytes()]})

    return _meet(packed, COVARIANCE_BLOCK, ordered=False).applyInPandas(
        work, "i int, j int, rows int, data binary")


def _block(row) -> np.ndarray:
    return np.frombuffer(row["data"]).reshape(row["rows"], -1)


def _tiled(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The blocks with the tile (_gi, _gj) each lies in, stored by tile: products shuffle vectors only."""
    tiles = -(-n_blocks // TILE_BLOCKS) ** 2
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiles // 8)
    tile = [F.floor(F.col(c) / TILE_BLOCKS).cast("int").alias(f"_g{c}") for c in "ij"]
    return cut_lineage(blocks.select("*", *tile).repartition(parts, "_gi", "_gj").sortWithinPartitions("_gi", "_gj"))


def _times(tiles: DataFrame, vectors: DataFrame, n_blocks: int, width: int) -> DataFrame:
    """b, tile, part: the matrix times ``vectors`` (b, v), in a part for each tile of the row.

    A vector is sent once to each tile of its column, so vectors and parts together are
    width / (TILE_BLOCKS x COVARIANCE_BLOCK) of the matrix.
    """
    last = -(-n_blocks // TILE_BLOCKS) - 1
    sent = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("_gi"),
                          F.floor(F.col("b") / TILE_BLOCKS).cast("int").alias("_gj"), "b", "v")

    def work(matrix: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        v = {b: np.frombuffer(x).reshape(-1, width) for b, x in zip(right["b"], right["v"])}
        sums: dict[int, np.ndarray] = {}
        for row in matrix.sort_values(["i", "j"]).to_dict("records"):
            sums[row["i"]] = sums.get(row["i"], 0.0) + _block(row) @ v[row["j"]]
        return pd.DataFrame({"b": list(sums), "tile": right["_gj"].iloc[0] if len(right) else 0,
                             "part": [x.tobytes() for x in sums.values()]})

    return tiles.groupBy("_gi", "_gj").cogroup(sent.groupBy("_gi", "_gj")).applyInPandas(
        work, "b int, tile int, part binary")


def _pair(frame: pd.DataFrame, at: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's rows of the space and of its image."""
    rows = frame["rows"].iloc[at]
    return (np.frombuffer(frame["space"].iloc[at]).reshape(rows, -1),
            np.frombuffer(frame["image"].iloc[at]).reshape(rows, -1))


def _gram(state: DataFrame, of) -> np.ndarray:
    """The sum over the blocks of x'y for (x, y) = of(space, image), a few columns each."""
    def work(batches):
        total = None
        for frame in batches:
            for at in range(len(frame)):
                x, y = of(*_pair(frame, at))
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(total.shape[0]), total.shape[1]),
                                "j": np.tile(np.arange(total.shape[1]), total.shape[0]), "v": total.ravel()})

    sums = state.mapInPandas(work, "i int, j int, v double").groupBy("i", "j").agg(
        F.sum("v").alias("v")).toPandas()
    out = np.zeros((sums["i"].max() + 1, sums["j"].max() + 1))
    out[sums["i"], sums["j"]] = sums["v"]
    return out


def _changed(state: DataFrame, of) -> DataFrame:
    """Each block's space and image replaced by of(space, image)."""
    def work(batches):
        for frame in batches:
            pairs = [of(*_pair(frame, at)) for at in range(len(frame))]
            for k, name in enumerate(("space", "image")):
                frame[name] = [np.ascontiguousarray(p[k]).tobytes() for p in pairs]
            yield frame

    return state.mapInPandas(work, state.schema)


def _extended(state: DataFrame, tiles: DataFrame, n_blocks: int, width: int, more) -> DataFrame:
    """``state`` with the ``width`` columns more(space, image) and their images added."""
    def add(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        space, image = _pair(own, 0)
        new = sum(np.frombuffer(p).reshape(len(space), width) for p in parts.sort_values("tile")["part"])
        return own.assign(space=[np.hstack([space, more(space, image)]).tobytes()],
                          image=[np.hstack([image, new]).tobytes()])

    added = _changed(state, lambda s, a: (more(s, a), a)).select("b", F.col("space").alias("v"))
    parts = _times(tiles, added, n_blocks, width)
    return cut_lineage(state.groupBy("b").cogroup(parts.groupBy("b")).applyInPandas(add, state.schema))


def _whitener(gram: np.ndarray) -> np.ndarray:
    """T with T' gram T = 1, without the directions that rounding leaves empty."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > 1e-10 * max(values[-1], np.finfo(float).tiny)
    return vectors[:, kept] / np.sqrt(values[kept])


def _leading(tiles: DataFrame, n_blocks: int, size: int, components: int):
    """The leading eigenvalues by size, and a table (b, space, image, rows) with the first vector.

    The residuals of the leading vectors extend a Krylov space until they vanish; a space
    grown large is started again from its leading vectors. Columns as long as the series
    are rows of the table, one for each block of series; the driver sees products of
    columns alone, at most 13 x (components + 4) squared of them.
    """
    width = min(size, components + 4)

    def random(batches):
        for frame in batches:
            yield frame.assign(image=[
                np.random.default_rng([1, b]).standard_normal((n, width)).tobytes()
                for b, n in zip(frame["b"], frame["rows"])])

    state = tiles.where("i = j").select(
        F.col("i").alias("b"), "rows", F.lit(b"").alias("space"), F.lit(b"").alias("image"))
    state = cut_lineage(state.mapInPandas(random, state.schema))
    first = _whitener(_gram(state, lambda s, a: (a, a)))
    first = first @ _whitener(_gram(state, lambda s, a: (a @ first,) * 2))
    state = _extended(state, tiles, n_blocks, first.shape[1], lambda s, a: a @ first)
    state = _changed(state, lambda s, a: (s, a[:, width:]))
    while True:
        product = _gram(state, lambda s, a: (s, a))
        values, inner = np.linalg.eigh((product + product.T) / 2)
        order = np.argsort(np.abs(values))[::-1]
        values, inner = values[order], inner[:, order]
        more, norms = _residuals(state, inner[:, :width], values[:width])
        limit = 1e-11 * max(abs(values[0]), np.finfo(float).tiny)
        if norms[:components].max() <= limit or len(values) >= size:
            break
        if len(values) > 12 * width:
            kept = inner[:, :4 * width]
            state = cut_lineage(_changed(state, lambda s, a, kept=kept: (s @ kept, a @ kept)))
            more, norms = _residuals(state, np.eye(kept.shape[1], width), values[:width])
        count = min(len(norms), size - len(values))
        more, count = _orthogonal(state, more, norms, count)
        if not count:
            break
        state = _extended(state, tiles, n_blocks, count, more)
    lead = inner[:, :1]
    return values[:components], _changed(state, lambda s, a: (s @ lead, a[:, :0]))


def _residuals(state: DataFrame, lead: np.ndarray, values: np.ndarray):
    """(function giving what the leading vectors' images differ from their multiples, its norms)."""
    def rest(s, a):
        return a @ lead - (s @ lead) * values

    return rest, np.sqrt(np.diag(_gram(state, lambda s, a: (rest(s, a),) * 2)))


def _orthogonal(state: DataFrame, more, norms: np.ndarray, count: int):
    """(``more`` with ``count`` columns at most, orthonormal and orthogonal to the space, their number)."""
    def scaled(s, a):
        return more(s, a) / np.maximum(norms, np.finfo(float).tiny)

    steps: list[tuple[np.ndarray, np.ndarray]] = []

    def out(s, a):
        x = scaled(s, a)
        for inside, turn in steps:
            x = (x - s @ inside) @ turn
        return x

    for _ in range(3):
        both = _gram(state, lambda s, a: (np.hstack([s, out(s, a)]), out(s, a)))
        inside, own = both[:-both.shape[1]], both[-both.shape[1]:]
        turn = _whitener(own - inside.T @ inside)[:, -count:]
        steps.append((inside, turn))
        if not turn.shape[1]:
            break
    return out, steps[-1][1].shape[1]


def _sum_of_sizes(blocks: DataFrame, largest: float) -> float:
    """Sum of the sizes of all eigenvalues: the trace of A sign(A).

    x (3 - x x) / 2 takes A / largest to its sign, in products of blocks.
    """
    spark, columns = blocks.sparkSession, "i int, j int, rows int, data binary"
    parts = blocks.sparkSession.sparkContext.defaultParallelism

    def product(a, b):
        left = a.map(lambda x: (x[0][1], (x[0][0], x[1])))
        right = b.map(lambda x: (x[0][0], (x[0][1], x[1])))
        return left.join(right, parts).map(lambda x: ((x[1][0][0], x[1][1][0]), x[1][0][1] @ x[1][1][1])).reduceByKey(np.add, parts)

    def stored(rdd):
        rows = rdd.map(lambda x: (x[0][0], x[0][1], len(x[1]), bytearray(np.ascontiguousarray(x[1]).tobytes())))
        return cut_lineage(spark.createDataFrame(rows, columns)).rdd.map(lambda r: ((r["i"], r["j"]), _block(r)))

    # A little less than 1, for what rounding adds to the largest.
    scale = (1 - 1e-9) / largest
    own = blocks.rdd.map(lambda r: ((r["i"], r["j"]), _block(r)))
    x, before = own.mapValues(lambda v: v * scale), 0.0
    while True:
        total = own.join(x, parts).map(lambda v: float((v[1][0] * v[1][1]).sum())).sum()
        if total - before <= 1e-11 * total:
            return total
        before = total
        cube = product(stored(product(x, x)), x)
        x = stored(x.join(cube, parts).mapValues(lambda v: 1.5 * v[0] - 0.5 * v[1]))


def _series_spectrum(packed: DataFrame, periods: int, components: int, all_sizes: bool):
    """(leading eigenvalues, sum of the sizes of all, first loadings) by the covariances of all series."""
    kind = packed.schema["series"].dataType.simpleString()
    n_blocks = max(1, -(-packed.count() // COVARIANCE_BLOCK))
    blocks = _tiled(_covariance_blocks(packed, periods), n_blocks)
    diagonal = blocks.where("i = j").select(F.col("i").alias("b"), "rows")
    size = diagonal.agg(F.sum("rows")).first()[0] or 0
    if size <= MAX_PATTERN_ROWS:
        places, at = {}, 0
        for row in diagonal.orderBy("b").collect():
            places[row["b"]] = slice(at, at + row["rows"])
            at += row["rows"]
        matrix = np.zeros((size, size))
        for row in blocks.toLocalIterator():
            matrix[places[row["i"]], places[row["j"]]] = _block(row)
        values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
        order = np.argsort(np.abs(values))[::-1]
        values, total = values[order], float(np.abs(values).sum())
        first = packed.sparkSession.createDataFrame(
            [(b, bytearray(vectors[at, order[0]].tobytes())) for b, at in places.items()], "b int, space binary")
    else:
        values, first = _leading(blocks, n_blocks, size, components)
        total = None
        if all_sizes:
            total = _sum_of_sizes(blocks.select("i", "j", "rows", "data"), abs(values[0])) if values[0] else 0.0
    flat = not np.abs(values).max(initial=0.0)

    def load(frame: pd.DataFrame, vector: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("series")
        loading = np.zeros(len(frame)) if flat else np.frombuffer(vector["space"].iloc[0])
        return pd.DataFrame({"component": 1, "series": frame["series"], "loading": loading})

    # The blocks of _meet.
    own = packed.select("series", F.pmod(F.hash("series"), F.lit(n_blocks)).alias("b"))
    loadings = own.groupBy("b").cogroup(first.groupBy("b")).applyInPandas(
        load, f"component int, series {kind}, loading double")
    return values[:components], total, loadings


def _by_patterns(packed: DataFrame, periods: int, components: int):
    """(leading eigenvalues, sum of the sizes of all, first loadings) by patterns of gaps."""
    products = {}
    for row in _pattern_products(packed, periods).collect():
        products.setdefault(row["pattern"], np.zeros(periods * periods))[row["place"]] = row["total"]
    eigen, weights = _pattern_spectrum(products, periods, components)

    def load(batches):
        for frame in batches:
            x = _matrix(frame, periods)[0]
            w = np.array([weights[p][0] for p in frame["pattern"]]).reshape(len(frame), periods)
            yield pd.DataFrame({"component": 1, "series": frame["series"], "loading": (x * w).sum(axis=1)})

    kind = packed.schema["series"].dataType.simpleString()
    return (eigen[:components], float(np.abs(eigen).sum()),
            packed.mapInPandas(load, f"component int, series {kind}, loading double"))


def _trace(packed: DataFrame) -> float:
    """The sum of the series' variances."""
    variances = packed.select("series", F.explode("v").alias("_v")).groupBy("series").agg(
        F.var_samp("_v").alias("_v"))
    return variances.agg(F.sum("_v")).first()[0] or 0.0


def gap_pca(panel: DataFrame, t: str, series: str, value: str,
            components: int = 5, all_sizes: bool = True) -> dict[str, DataFrame]:
    """PCA of anomalies with missing values, from pairwise covariances.

    The covariance of two series is a form in their values whose coefficients depend
    on the two patterns of periods alone. So the matrix over all series has the
    eigenvalues of one of (patterns x periods) rows, made from the sums of products
    between periods within each pattern, map-side. Where that is the smaller one and has
    at most ``MAX_PATTERN_ROWS`` rows, the driver decomposes it; else it decomposes the
    series x series matrix, and beyond as many series that matrix stays in blocks, the
    leading components come from products with it, and vectors as long as the series are
    tables too. Neither series nor patterns are limited. Scores are sums over the values
    present, standardised.

    ``share`` is a component's part of the sum of the sizes of all eigenvalues (pairwise
    covariances may have negative ones), ``trace_share`` its part of the sum of the series'
    variances. For a matrix in blocks the first sum takes products of whole matrices,
    cubic in the series; with ``all_sizes=False`` ``share`` is NULL there.
    """
    panel = cut_lineage(panel.select(t, series, value))
    cells = anomaly(panel, t, value, skip_missing=True, out="_a").select(t, series, "_a").filter(
        F.col("_a").isNotNull())
    packed, periods = pack_series(cells, t, series, "_a")
    packed = cut_lineage(packed.withColumn("pattern", F.array_join(F.array_sort("at"), ",")))
    rows = packed.select("pattern").distinct().count() * periods
    if rows <= min(MAX_PATTERN_ROWS, packed.count()):
        eigen, total, first = _by_patterns(packed, periods, components)
    else:
        eigen, total, first = _series_spectrum(packed, periods, components, all_sizes)
    first, trace = cut_lineage(first.withColumnRenamed("series", series)), _trace(packed)
    shares = panel.sparkSession.createDataFrame(
        [(k + 1, float(abs(v)), None if total is None else float(abs(v)) / total if total else float("nan"),
          float(abs(v)) / trace if trace else float("nan")) for k, v in enumerate(eigen)],
        "component int, eigenvalue double, share double, trace_share double")
    scores = same_keys_join(cells, first, [series], "inner").groupBy("component", t).agg(
        F.sum(F.col("_a") * F.col("loading")).alias("score"))
    loadings, scores = _oriented(first, scores, [], t)
    return {
        "shares": shares,
        "loadings": loadings.drop("component"), "scores": scores.drop("component"),
    }
