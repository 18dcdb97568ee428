"""Session settings and the few helpers that decide physical shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Side tables up to this size are broadcast, after counting their rows.
BROADCAST_BYTES = 32 * 1024 * 1024
# A row of group statistics: a few keys and numbers.
ROW_BYTES = 160


def build_session(app: str = "trawlframe", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew handling and ANSI arithmetic on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{key.replace("__", "."): str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting, as in tests, gets one: ``_scratch`` in
    its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder the cluster names.

    Used where two branches of a plan must see the very same rows (a range
    partitioning is sampled, so computing it twice may give two answers) and
    where a small table is measured before it is broadcast. Survives the loss
    of executors, unlike a local checkpoint.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint()


def same_keys_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which two NULL keys match, keeping the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b,
        [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys],
    )
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def attach_groups(df: DataFrame, stats: DataFrame, by: list[str],
                  row_bytes: int = ROW_BYTES) -> DataFrame:
    """Put one row of group statistics beside every row of its group.

    This replaces a window over the whole group, which would send each group
    to one task. The statistics are already aggregated map-side; they are
    materialised and counted, broadcast when few, and joined by key when many
    (many groups spread well, and the adaptive skew join splits a hot one).
    ``row_bytes`` is the size of one row, for statistics that hold arrays.
    """
    if not by:
        return attach_single(df, stats)
    stats = cut_lineage(stats)
    if stats.count() * row_bytes <= BROADCAST_BYTES:
        stats = F.broadcast(stats)
    return same_keys_join(df, stats, by)


def attach_single(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the values of a one-row aggregate beside every row."""
    values = one_row.first().asDict()
    types = {f.name: f.dataType for f in one_row.schema.fields}
    return df.withColumns({name: F.lit(v).cast(types[name]) for name, v in values.items()})


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Few rows about to become many: over all shuffle partitions, not merged again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def single_value(one_row: DataFrame):
    """The only value of a one-row, one-column aggregate."""
    return one_row.first()[0]
