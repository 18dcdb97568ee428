"""Reading and writing survey tables (CSV with 'NA', Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "CATCH_SCHEMA", "HAUL_SCHEMA", "STRATA_SCHEMA", "read_table", "write_table",
    "null_sentinels", "rename_all", "drop_row_numbers", "write_imputations", "read_imputations",
]


def _schema(**fields) -> T.StructType:
    kinds = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k], True) for n, k in fields.items()])


CATCH_SCHEMA = _schema(
    hauljoin="string", station="string", year="int", cruise="int", cw="double",
    sc="int", sex="int", clutch="int", sample_factor="double",
)
HAUL_SCHEMA = _schema(
    hauljoin="string", station="string", year="int", distance_fished="double",
    net_width="double", lat="double", lon="double", gear_temp="double",
    haul_type="int", performance="int", stratum_fish="int",
)
STRATA_SCHEMA = _schema(
    station="string", district="string", tows="int", stratum="int",
    total_area="double", year="int",
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table from CSV (header, 'NA' is NULL; the schema is never guessed) or Parquet."""
    if path.endswith(".csv") or path.endswith(".csv.gz"):
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        return spark.read.csv(path, schema=schema, header=True, nullValue="NA",
                              ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Write a table; every result has its own path, an existing one is not replaced."""
    writer = df.write.mode(mode)
    if partition_by:
        # One task writes each partition folder unless adaptive execution
        # splits a large one, so small files do not pile up.
        writer = df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, nullValue="NA")
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("fmt is 'parquet' or 'csv'")


def null_sentinels(df: DataFrame, sentinels: dict) -> DataFrame:
    """Replace a stand-in value such as -9999 by NULL, column by column."""
    return df.withColumns({
        name: F.when(F.col(name) != F.lit(value), F.col(name))
        for name, value in sentinels.items()
    })


def rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    """Give every column a new name, in order."""
    return df.toDF(*names)


def drop_row_numbers(df: DataFrame, names=("", "_c0", "X", "...1")) -> DataFrame:
    """Drop the unnamed row-number column that a CSV written elsewhere may carry."""
    return df.drop(*[c for c in df.columns if c in names])


def write_imputations(df: DataFrame, path: str, mode: str = "error") -> None:
    """Keep completed data sets, one folder for each imputation."""
    write_table(df, path, partition_by=["imputation"], mode=mode)


def read_imputations(spark: SparkSession, path: str, which: list[int] | None = None) -> DataFrame:
    """Read kept imputations; ``which`` prunes to the named ones."""
    df = spark.read.parquet(path)
    return df if which is None else df.filter(F.col("imputation").isin(which))
