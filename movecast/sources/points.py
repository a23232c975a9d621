"""Readers of point tables and streams, and of stored results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POINT, STORED


def decode_points(df: DataFrame, fields: int = 6, value: str = "value", seq: str | None = None) -> DataFrame:
    """Comma-separated text (or bytes) -> points.

    Six fields: id, timestamp, longitude, latitude, speed, heading. Four: the first four, with speed = heading = 0.
    ``seq`` names a column that numbers the arrivals. A field that is not a number fails the query, as a malformed
    record should.
    """
    if fields not in (4, 6):
        raise ValueError("fields is 4 or 6")
    part = F.split(F.col(value).cast("string"), ",")

    def field(k: int) -> Column:
        f = POINT.fields[k]
        text = F.trim(F.element_at(part, k + 1)) if k < fields else F.lit("0")
        return text.cast(f.dataType).alias(f.name)

    return df.select(*[field(k) for k in range(6)], *([F.col(seq).alias("seq")] if seq else []))


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """Point files with one header line; malformed lines fail the read."""
    return spark.read.schema(POINT).option("header", True).option("mode", "FAILFAST").csv(path)


def stream_points_csv(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same files as a stream: a folder that is replayed a few files per micro-batch.

    ``seq`` orders lines as they arrived, however many files come together: files by the time and name by which the source
    takes them, then the lines as they stand in their file. It is text of fixed width (time, name, block, line), so it sorts as such.
    """
    reader = spark.readStream.schema(POINT).option("header", True).option("mode", "FAILFAST")
    lines = reader.option("maxFilesPerTrigger", files_per_trigger).csv(path)
    file = F.concat_ws(
        "|",
        F.format_string("%019d", F.unix_micros("_metadata.file_modification_time")),
        F.col("_metadata.file_path"),
        F.format_string("%019d", F.col("_metadata.file_block_start")),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POINT.fields)
    return lines.select(*POINT.fieldNames(), file.alias("file")).mapInArrow(_numbered, f"{schema}, seq string")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their line within the block of their file; a task reads one block after the other."""
    last, count = None, 0
    for batch in batches:
        files = batch.column("file").to_pylist()
        seq = []
        for file in files:
            count = count + 1 if file == last else 0
            last = file
            seq.append(f"{file}|{count:019d}")
        yield batch.drop_columns(["file"]).append_column("seq", pa.array(seq, pa.string()))


def read_points_kafka(
    spark: SparkSession, servers: str, topics: str, fields: int = 6, options: dict[str, str] | None = None
) -> DataFrame:
    """Point stream from Kafka topics (needs the Kafka connector on the class path).

    Records of one object must share a topic partition, as they do when keyed by id: their offset is the arrival order.
    The consumer group is passed through ``options`` (``kafka.group.id``), as are starting offsets and rate limits.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    for key, text in (options or {}).items():
        reader = reader.option(key, text)
    return decode_points(reader.load(), fields, seq="offset")


def stored_table(spark: SparkSession, name: str, path: str, kind: str, buckets: int) -> DataFrame:
    """A stored table of forecasts or actuals whose rows lie in buckets by (id, timestamp), made where it is missing.

    The definition goes to the session's catalog, the rows stay under ``path``; with the same ``buckets`` any later session finds
    them there. Two such tables of as many buckets meet in ``score`` without a shuffle.
    """
    columns, parts = STORED[kind]
    quoted = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    partitioned = f"PARTITIONED BY ({', '.join(parts)}) " if parts else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({quoted}) USING parquet {partitioned}"
        f"CLUSTERED BY (id, timestamp) SORTED BY (id, timestamp) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if parts and folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Stored forecasts, by column name; filters on variant and horizon prune folders."""
    return spark.read.parquet(path)


def read_actuals(
    spark: SparkSession, path: str | None = None, *, jdbc_url: str | None = None, table: str | None = None,
    partitions: int = 64, id_range: tuple[int, int] | None = None, options: dict[str, str] | None = None,
) -> DataFrame:
    """True positions (id, timestamp, longitude, latitude) from parquet or from a database table.

    Database reads are split over ``id_range`` so that no single task pulls the whole table.
    """
    if (path is None) == (jdbc_url is None):
        raise ValueError("give either path or jdbc_url")
    if path is not None:
        df = spark.read.parquet(path)
    else:
        if id_range is None:
            raise ValueError("jdbc reads need id_range to be split")
        reader = spark.read.format("jdbc").options(
            url=jdbc_url, dbtable=table, partitionColumn="id", lowerBound=str(id_range[0]),
            upperBound=str(id_range[1]), numPartitions=str(partitions), **(options or {}),
        )
        df = reader.load()
    return df.select("id", "timestamp", "longitude", "latitude")
