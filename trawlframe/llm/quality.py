"""Document quality by a regularised quadratic discriminant."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.words import per_row, text_bytes, word_hashes

# What a statistic is divided by besides its own count: short texts stay near the middle.
PSEUDO_WORDS = 25
FEATURES = ("marks", "capitals", "exclamations", "bars", "digits", "letters", "word_size",
            "same_as_last", "distinct", "words", "long_words")


def _table(*wanted: str | range) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for part in wanted:
        out[[ord(c) for c in part] if isinstance(part, str) else list(part)] = 1
    return out


# Bytes of each kind; bytes from 0x80 on belong to letters beyond A-Z.
KINDS = [_table("#$%&*@^~_=+<>\\{}"), _table(range(65, 91)), _table("!"), _table("|"),
         _table(range(48, 58)), _table(range(65, 91), range(97, 123), range(128, 256)),
         _table(range(128, 192))]


def _statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n = len(bounds) - 1

    def count(kind):
        return np.diff(np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])[bounds])

    marks, capitals, shouts, bars, digits, letters, tails = map(count, KINDS)
    chars = np.diff(bounds) - tails
    hashes, sizes, rows = word_hashes(data, bounds)
    words = np.bincount(rows, minlength=n)
    same = np.bincount(rows[1:], (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1]), minlength=n)
    keys = np.unique(rows.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    distinct = np.diff(per_row((keys >> np.uint64(40)).astype(np.int64), n))
    long_words = np.bincount(rows, sizes > 20, minlength=n)
    base = words + PSEUDO_WORDS
    letters_seen = letters - tails
    return np.column_stack([
        np.log1p(20 * marks / base), np.log1p(20 * capitals / (letters_seen + 4 * PSEUDO_WORDS)),
        np.log1p(20 * shouts / base), np.log1p(20 * bars / base), np.log1p(20 * digits / base),
        (letters_seen + 4 * PSEUDO_WORDS) / (chars + 5 * PSEUDO_WORDS),
        np.log((chars + 5 * PSEUDO_WORDS) / base), np.log1p(20 * same / base),
        (distinct + 0.75 * PSEUDO_WORDS) / base, np.log(base), np.log1p(20 * long_words / base)])


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and ``x``: the transformed statistics (FEATURES) of every whole text, one narrow pass.

    Counts are taken per word or letter, with PSEUDO_WORDS words of ordinary text
    added, and pressed by a logarithm. A null text counts as empty.
    """
    source = docs.select(F.col(id_column), F.coalesce(text_column, F.lit("")).alias("_text"))
    id_type = source.schema[0].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for a, b, data, bounds in text_bytes(batch.column(1)):
                x = _statistics(data, bounds)
                offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], [id_column, "x"])

    return source.mapInArrow(work, f"`{id_column}` {id_type}, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunk covariances, log weights."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, from the difference of the two log densities."""
        if not self.means:
            return np.full(len(x), self.share)
        density = [offset - 0.5 * np.square((x - mean) @ factor.T).sum(axis=1)
                   for mean, factor, offset in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit_discriminant(examples: DataFrame, shrinkage: float = 0.5, ridge: float = 0.02) -> Discriminant:
    """From rows with ``x`` and ``label`` (0 or 1), all of them, by one aggregation of sums.

    A class covariance is moved by ``shrinkage`` towards the mean of both classes
    (each counted alike, since good documents are many and alike) and then by
    ``ridge`` towards its mean variance. Sums of products are taken map-side; the
    driver sees two rows. With one class alone, or none, every score is the share
    of label 1 (0.5 without labels).
    """
    d = len(FEATURES)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = {r["label"]: r for r in examples.where("label in (0, 1)").groupBy("label")
            .agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    total = sum(r["n"] for r in rows.values())
    share = rows[1]["n"] / total if 1 in rows else 0.0 if rows else 0.5
    if len(rows) < 2:
        return Discriminant([], [], [], share)
    means, covariances = [], []
    for label in (0, 1):
        r = rows[label]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
    middle = (covariances[0] + covariances[1]) / 2
    factors, offsets = [], []
    for label, own in enumerate(covariances):
        shrunk = (1 - shrinkage) * own + shrinkage * middle
        shrunk = (1 - ridge) * shrunk + ridge * (np.trace(shrunk) / d + 1e-9) * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(rows[label]["n"] / total) - np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, offsets, share)


def score_statistics(statistics: DataFrame, model: Discriminant) -> DataFrame:
    """Adds ``score`` to rows with ``x``."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.vstack(x.to_numpy()))) if len(x) else pd.Series(dtype=float)

    return statistics.withColumn("score", score("x"))


def keep_good(docs: DataFrame, model: Discriminant, threshold: float, text_column: str = "text") -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns; one narrow pass."""
    at = docs.columns.index(text_column)

    def work(batches):
        for batch in batches:
            texts = batch.column(at)
            scores = np.empty(batch.num_rows)
            for a, b, data, bounds in text_bytes(texts.fill_null("")):
                scores[a:b] = model.scores(_statistics(data, bounds))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(work, docs.schema)


def settled_labels(labels: DataFrame, label: str, id_column: str = "doc_id") -> DataFrame:
    """id and ``label`` of documents whose label is known and not contradicted by a second row."""
    return (labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
            .groupBy(id_column).agg(F.min(label).alias("label"), F.max(label).alias("_most"))
            .where("label = _most").drop("_most"))
