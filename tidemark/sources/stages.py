"""Stage tables: Parquet in buckets of a key, a version for each set of inputs and parameters, counted as there once its manifest is."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_MANIFEST.json"


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fingerprint(spark: SparkSession, inputs: list[DataFrame], parameters: dict) -> str:
    """A name for what a stage is made from: every input file's path, length and time, and the parameters."""
    files = []
    for path in sorted({f for df in inputs for f in df.inputFiles()}):
        fs, place = _filesystem(spark, path)
        status = fs.getFileStatus(place)
        files.append([path, status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps([files, parameters], sort_keys=True, default=str).encode()).hexdigest()[:24]


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a version, or None where it isn't whole."""
    fs, place = _filesystem(spark, f"{path}/{MANIFEST}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write the manifest under another name and rename it: it is there whole or not at all."""
    fs, place = _filesystem(spark, f"{path}/{MANIFEST}")
    _, draft = _filesystem(spark, f"{path}/_draft-{hashlib.sha256(json.dumps(manifest).encode()).hexdigest()[:8]}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if not fs.rename(draft, place) and not fs.exists(place):
        raise OSError(f"{place} can't be written")


def bucketed(spark: SparkSession, base: str, name: str, inputs: list[DataFrame], make: Callable[[], DataFrame], keys: list[str], order: list[str], buckets: int, **parameters) -> DataFrame:
    """make()'s rows, from the version of the stage `name` below base that fits the inputs and parameters; made first where there is none.

    Rows lie in `buckets` buckets of the keys, sorted by keys and order in each file. What groups, windows or joins such tables by the
    keys (the same number of buckets) needs no further shuffle. Other versions stay as they are.
    """
    version = fingerprint(spark, inputs, {"keys": keys, "order": order, "buckets": buckets, **parameters})
    path, table = f"{base.rstrip('/')}/{name}/{version}", f"stage_{name}_{version}"
    manifest = read_manifest(spark, path)
    sort = [*keys, *(c for c in order if c not in keys)]
    spark.sql(f"drop table if exists {table}")  # the name in this session's catalog; the files are outside of it
    if manifest is None:
        fs, place = _filesystem(spark, path)
        fs.delete(place, True)  # what a broken call has left
        rows = make().repartition(buckets, *keys)  # one file a bucket
        rows.write.bucketBy(buckets, *keys).sortBy(*sort).option("path", path).format("parquet").saveAsTable(table)
        commit(spark, path, {"version": version, "schema": rows.schema.simpleString()[7:-1], "keys": keys, "sort": sort, "buckets": buckets, "parameters": {k: str(v) for k, v in parameters.items()}})
        return spark.table(table)
    fields = ", ".join(f"`{c}` {t}" for c, t in (f.split(":", 1) for f in _fields(manifest["schema"])))
    quoted = lambda columns: ", ".join(f"`{c}`" for c in columns)
    spark.sql(f"create table {table} ({fields}) using parquet clustered by ({quoted(keys)}) sorted by ({quoted(sort)}) into {buckets} buckets location '{path}'")
    return spark.table(table)


def _fields(schema: str) -> list[str]:
    """The fields of a struct's short text, commas inside of types left alone."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]
