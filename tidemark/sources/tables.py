"""Readers and writers with explicit schemas, and stage outputs that are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTENS = "user_id string, timestamp string, artist_id string, artist_name string, track_id string, track_name string"
RATINGS = "user_id string, parent_asin string, rating string, timestamp string"
REVIEWS = "user_id string, parent_asin string, text string, timestamp string"
METADATA = "parent_asin string, title string, author string, description string"
RESULTS = "user_id string, system string, `recall@10` double, `long_tail_recall@10` double"
#: Texts that count as missing where pandas_na is asked for (fixed values).
NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _na(df: DataFrame, pandas_na: bool) -> DataFrame:
    if not pandas_na:
        return df
    return df.select(*(F.when(~F.col(f"`{f.name}`").isin(NA_TEXTS), F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields))


def read_listens(spark: SparkSession, path: str, pandas_na: bool = False, pattern: str = "*.tsv*") -> DataFrame:
    """Tab-separated listens without a header, in the files found below path, gz or not.

    Short lines are filled with nulls, empty fields are null, quotes are text; blank lines and those with
    more fields than columns are left out.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    names, fields = [c.split()[0] for c in LISTENS.split(", ")], F.split("value", "\t", -1)
    good = lines.where((F.col("value") != "") & (F.size(fields) <= len(names)))
    return _na(good.select(*(F.nullif(F.get(fields, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names))), pandas_na)


def read_csv(spark: SparkSession, path: str, schema: str, pandas_na: bool = False, multi_line: bool = True) -> DataFrame:
    """A CSV with a header, gz or not; quoted fields may hold doubled quotes, and line ends unless multi_line is False, which lets Spark split files."""
    return _na(spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path), pandas_na)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Per-user results; an empty long-tail cell is null."""
    raw = read_csv(spark, path, RESULTS, multi_line=False)
    return raw.select("user_id", "system", F.col("`recall@10`").alias("recall"), F.col("`long_tail_recall@10`").alias("lt_recall"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gz or not; lines that can't be parsed are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    from pyspark.sql.window import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", "").option("emptyValue", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Without a header, missing values as empty text."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.mode("overwrite").option("sep", "\t").option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it isn't there whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        write_parquet(make(), path)
    return spark.read.parquet(path)
