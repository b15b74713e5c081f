"""Tables in and out: Spark, pandas and Arrow frames, files, views and saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.ident import table_name


def as_frame(spark: SparkSession, data: object) -> DataFrame:
    """A Spark DataFrame of a Spark, pandas or Arrow table, or of a list of rows."""
    if hasattr(data, "sparkSession"):
        return data
    if hasattr(data, "to_pandas") and not hasattr(data, "iloc"):
        return spark.createDataFrame(data)
    if hasattr(data, "iloc"):
        return spark.createDataFrame(data.where(data.notna(), None) if data.isna().any().any() and all(t == object for t in data.dtypes) else data)
    if isinstance(data, list):
        return spark.createDataFrame(data)
    raise TypeError(f"expected a Spark, pandas or Arrow table, got {type(data).__name__}")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options: object) -> DataFrame:
    """CSV with a header; give ``schema`` to spare the pass that infers it."""
    reader = spark.read.options(header=True, **options)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def query(df: DataFrame, sql: str, **args: object) -> DataFrame:
    """SQL over a frame as ``{input}``, values bound as ``:name``."""
    return df.sparkSession.sql(sql, args=args or None, input=df)


def register(spark: SparkSession, data: object, name: str, persist: bool = False) -> DataFrame:
    """Create or replace a table: a view of the session, or with ``persist`` a saved table."""
    df = as_frame(spark, data)
    if persist:
        df.write.mode("overwrite").saveAsTable(table_name(name))
        return spark.table(name)
    df.createOrReplaceTempView(table_name(name))
    return spark.table(name)


def to_table(data: object, name: str, spark: SparkSession | None = None) -> tuple[DataFrame, SparkSession]:
    spark = spark or getattr(data, "sparkSession", None) or SparkSession.getActiveSession()
    return register(spark, data, name), spark


def tidy_to_table(tidy: object, spark: SparkSession | None = None, table: str = "model_tidy") -> tuple[str, SparkSession]:
    """Register a tidy frame with dots in its column names made underscores; the frame itself stays as it is."""
    spark = spark or getattr(tidy, "sparkSession", None) or SparkSession.getActiveSession()
    df = as_frame(spark, tidy)
    register(spark, df.toDF(*(c.replace(".", "_") for c in df.columns)), table)
    return table, spark


tidy_to_duckdb, to_duckdb = tidy_to_table, to_table
