"""File readers and the catalog as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, max_lines: int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; without a schema it is inferred."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(path)
    return df.limit(max_lines) if max_lines is not None else df


def read_csv(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """CSV with a header; every column is a string."""
    df = spark.read.option("header", True).csv(path)
    return df.limit(max_lines) if max_lines is not None else df


def read_text(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """(value) lines, without white space at their end."""
    df = spark.read.text(path).select(F.regexp_replace("value", r"(?U)\s+$", "").alias("value"))
    return df.limit(max_lines) if max_lines is not None else df


def read_file(spark: SparkSession, path: str, kind: str = "text", max_lines: int = 100) -> DataFrame:
    readers = {"text": read_text, "json": read_json, "csv": read_csv}
    if kind not in readers:
        raise ValueError(f"unknown format {kind}")
    return readers[kind](spark, path, max_lines)


def from_rows(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def json_stream(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """New JSON files of a folder as a stream, with the time of ingestion and the file each row came from."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.withColumn("ingested_at", F.current_timestamp()).withColumn("source_file", F.col("_metadata.file_path"))


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream of its files, be it a folder or a single file."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def topic_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A Kafka topic as a stream; needs the connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()


def describe(spark: SparkSession, table: str) -> DataFrame:
    """(col_name, data_type, comment) of a table: the rows of DESCRIBE up to the first blank one, without headings."""
    rows = []
    for r in spark.sql(f"DESCRIBE TABLE {_quoted(table)}").collect():
        if not r.col_name:
            break
        if not r.col_name.startswith("#"):
            rows.append((r.col_name, r.data_type, r.comment))
    return spark.createDataFrame(rows, "col_name string, data_type string, comment string")


def table_info(spark: SparkSession, table: str, include_sample: bool = True) -> dict:
    """Columns, properties (location, provider, owner, comment), row count and up to five rows of a table."""
    wanted = {"Location", "Provider", "Owner", "Comment"}
    details = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(table)}").collect() if r.col_name in wanted}
    df = spark.table(table)
    info = {"columns": [r.asDict() for r in describe(spark, table).collect()], "properties": details, "rows": df.count()}
    return info | ({"sample": [r.asDict(recursive=True) for r in df.limit(5).collect()]} if include_sample else {})


def table_comment(spark: SparkSession, table: str) -> str | None:
    """The comment of a table, or null."""
    found = [r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(table)}").collect() if r.col_name == "Comment"]
    return found[0] if found else None


def schema_context(spark: SparkSession, schema: str, columns: int = 5) -> DataFrame:
    """(table_name, columns) of a schema: the first few columns as `name: type`, with an ellipsis when exactly that many were kept."""
    rows = []
    for t in spark.catalog.listTables(schema):
        found = spark.catalog.listColumns(t.name if t.isTemporary else f"{schema}.{t.name}")[:columns]
        rows.append((t.name, ", ".join(f"{c.name}: {c.dataType}" for c in found) + ("..." if len(found) == columns else "")))
    return spark.createDataFrame(rows, "table_name string, columns string")


def search_tables(spark: SparkSession, pattern: str, limit: int = 20, catalog: str | None = None, schema: str | None = None) -> DataFrame:
    """(namespace, table_name, comment) of tables whose name or comment contains a pattern, whatever the case.

    Searches the schema that is given, all schemas of the catalog that is given, or else the
    current schema. Metadata only; no table is read.
    """
    if schema is not None:
        spaces = [f"{catalog}.{schema}" if catalog else schema]
    elif catalog is not None:
        spaces = [f"{catalog}.{r[0]}" for r in spark.sql(f"SHOW SCHEMAS IN {_quoted(catalog)}").collect()]
    else:
        spaces = [None]
    rows = []
    for space in spaces:
        for r in spark.sql(f"SHOW TABLES{f' IN {_quoted(space)}' if space else ''}").collect():
            full = r.tableName if r.isTemporary or not r.namespace else f"{space or r.namespace}.{r.tableName}"
            rows.append((r.namespace or None, r.tableName, None if r.isTemporary else table_comment(spark, full)))
    held = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern.lower()))
    found = spark.createDataFrame(rows, "namespace string, table_name string, comment string").distinct()
    return found.filter(held(F.col("table_name")) | held(F.col("comment"))).orderBy("table_name").limit(limit)


def table_context(spark: SparkSession, table: str) -> str:
    """What a prompt is told of a table: its name, comment and columns with their types and comments."""
    lines = [f"Table: {table}"] + ([f"Comment: {c}"] if (c := table_comment(spark, table)) else [])
    return "\n".join(lines + [f"- {r.col_name}: {r.data_type}" + (f" ({r.comment})" if r.comment else "") for r in describe(spark, table).collect()])


def _quoted(table: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in table.split("."))
