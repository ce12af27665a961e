"""Delimited and nested files in, result tables and row archives out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("servers", T.MapType(T.StringType(), T.StructType([
        T.StructField("active", T.StringType()), T.StructField("version", T.StringType()),
        T.StructField("readfor", T.ArrayType(T.StringType())), T.StructField("writefor", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("clusters", T.MapType(T.StringType(), T.StructType([
        T.StructField("active", T.StringType()), T.StructField("schemas", T.ArrayType(T.StringType())),
        T.StructField("primary", T.StringType()), T.StructField("failover", T.StringType()),
        T.StructField("servers", T.ArrayType(T.StringType())),
    ]))),
])


def read_delimited(spark: SparkSession, path, schema: str, null_token: str = "null", sep: str = "\t") -> DataFrame:
    """Delimited text with a token for NULL; the schema is given, so files are read once."""
    return spark.read.csv(path, sep=sep, schema=schema, nullValue=null_token, quote="")


def read_documents(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Servers and clusters of topology documents, one row each."""
    return flatten_documents(spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=True))


def flatten_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    servers = docs.select(F.explode("servers").alias("server", "_d")).select("server", "_d.*")
    clusters = docs.select(F.explode("clusters").alias("cluster", "_d")).select("cluster", "_d.*")
    return servers, clusters


def quoted(col: Column, numeric: bool) -> Column:
    """A value as SQL text; quotes and backslashes escaped, NULL unquoted."""
    text = col.cast("string")
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.coalesce(text if numeric else F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("NULL"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """Each row as one INSERT statement."""
    numeric = (T.NumericType,)
    values = [quoted(F.col(f.name), isinstance(f.dataType, numeric)) for f in df.schema.fields]
    names = ",".join(f"`{c}`" for c in df.columns)
    return df.select(F.concat(F.lit(f"INSERT INTO `{table}` ({names}) VALUES ("), F.concat_ws(",", *values), F.lit(");")).alias("value"))


def archive_rows(df: DataFrame, table: str, path: str, where: str | None = None, limit: int | None = None) -> None:
    """Write rows matching a condition as INSERT statements."""
    x = df if where is None else df.filter(F.expr(where))
    insert_statements(x if limit is None else x.limit(limit), table).write.mode("errorifexists").text(path)


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append observations, by date when given."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def usage_rows(counters: DataFrame, collected_at) -> DataFrame:
    """Usage counters with the time of collection, ready to append."""
    at = F.lit(collected_at).cast("timestamp")
    return counters.withColumn("collected_at", at).withColumn("collected_date", F.to_date(at))
