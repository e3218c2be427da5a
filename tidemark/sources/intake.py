"""Raw files, gz or not, taken into Parquet tables: each file once, what can't be read kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StringType, StructType

from .shared import release
from .tables import LISTENS

#: Partitions that the lines of a file which can't be split are dealt to before they are parsed.
SPREAD = 64


def _fields(name: str, schema: str) -> StructType:
    return StructType([*StructType.fromDDL(schema).fields, StructField("_bad", StringType())])


def parsed(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    """lines with the struct `row` (null where a line can't be read). kind: jsonl, csv (its header lines left out) or tsv."""
    fields = StructType.fromDDL(schema)
    if kind == "jsonl":
        row = F.from_json("value", _fields("jsonl", schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    elif kind == "csv":
        lines = lines.where(F.col("value") != ",".join(f.name for f in fields))
        row = F.from_csv("value", _fields("csv", schema).simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"'})
    elif kind == "tsv":
        part = F.split("value", "\t", -1)
        values = [F.nullif(F.get(part, F.lit(i)), F.lit("")).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
        row = F.struct(*values, F.when(F.size(part) > len(fields), F.col("value")).alias("_bad"))
    else:
        raise ValueError(kind)
    whole = lines.where(F.trim("value") != "").withColumn("_row", row)
    good = F.col("_row").isNotNull() & F.col("_row._bad").isNull()
    return whole.select("file", "line", F.when(good, F.struct(*(F.col(f"_row.`{f.name}`") for f in fields))).alias("row"), F.when(~good, F.col("value")).alias("rejected"))


def take(spark: SparkSession, path: str, table: str, kind: str, schema: str, pattern: str = "*", spread: int = SPREAD) -> DataFrame:
    """The rows of all files below path that match, kept in the folder `table`; a further call reads only files that have come since.

    The list of files done is the stream's checkpoint. A batch of files has its own folder, written over if the batch is done again, so a
    broken call leaves nothing twice. Lines get a number that rises within a file where they are read, and are then dealt to `spread` tasks, as a gz file is
    read by one. Rows come with batch, file and line, by which the first of several is known.
    """
    lines = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_path").alias("file"))

    def keep(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("line", F.monotonically_increasing_id()).repartition(spread)
        parsed(numbered, kind, schema).withColumn("ok", F.col("row").isNotNull()).write.mode("overwrite").partitionBy("ok").parquet(f"{table}/rows/batch={number}")

    lines.writeStream.foreachBatch(keep).option("checkpointLocation", f"{table}/done").trigger(availableNow=True).start().awaitTermination()
    release(spark)
    return _kept(spark, table, schema).where("ok").select("batch", "file", "line", "row.*")


def _kept(spark: SparkSession, table: str, schema: str) -> DataFrame:
    fields = StructType.fromDDL(f"file string, line bigint, row struct<{schema.replace(' ', ': ').replace(',: ', ', ')}>, rejected string, batch bigint, ok boolean")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/rows")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], fields)  # no file has come
    return spark.read.schema(fields).parquet(f"{table}/rows")


def rejected(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """batch, file, line and text of what take() couldn't read."""
    return _kept(spark, table, schema).where("not ok").select("batch", "file", "line", "rejected")


def take_listens(spark: SparkSession, path: str, table: str) -> DataFrame:
    return take(spark, path, table, "tsv", LISTENS, "*.tsv*")
