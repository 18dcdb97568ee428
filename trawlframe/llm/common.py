"""What several of the operators share: tables, text folding, bounded batches."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.session import scratch_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters of text that one step of a Python worker holds as arrays.
CHUNK_CHARS = 1_000_000
# Whether the files of a query's shuffles go when it ends; they are kept otherwise as long as its plan.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; nothing else changes."""
    return F.translate(text, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again.

    For loops: unlike a checkpoint, a table carries no constraints of the plan that
    made it, which would multiply from round to round. The shuffles behind it are
    deleted once it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/table-{uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    folder = f"{scratch_folder(df.sparkSession).rstrip('/')}/table-"
    for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if parent.rsplit("/", 1)[-1].startswith(folder.rsplit("/", 1)[-1]):
            delete_folder(df.sparkSession, parent)


def delete_folder(spark: SparkSession, name: str) -> None:
    """Delete a folder that this session made, on whatever file system it lies."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def slices(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose sizes add up to ``limit`` or hold one row."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
