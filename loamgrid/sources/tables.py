"""Scans, sinks, manifests and resumable task tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV with a header; codes declared as strings keep their leading zeros."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def read_header_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of arrays whose first row is the header, all cells as strings, nulls kept.

    Nested cells, rows of another length and repeated headers are errors.
    """
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", T.ArrayType(T.ArrayType(T.StringType())), {"mode": "FAILFAST"})).alias("n", "cells"))
    header = rows.filter("n = 0").first()["cells"]
    if len(set(header)) != len(header):
        raise ValueError("repeated header names")
    body = rows.filter("n > 0")
    bad = body.filter((F.size("cells") != len(header)) | F.exists("cells", lambda c: F.coalesce(F.substring(F.ltrim(c), 1, 1).isin("[", "{"), F.lit(False))))
    if not bad.isEmpty():
        raise ValueError("ragged rows or nested cells")
    return body.select(*[F.element_at("cells", i + 1).alias(h) for i, h in enumerate(header)])


def merge_batches(parts: list[DataFrame], on: list[str]) -> DataFrame:
    """Inner merge of column batches that must hold the same keys once each."""
    out = parts[0]
    n = out.count()
    for p in parts:
        if p.count() != n or p.select(*on).distinct().count() != n:
            raise ValueError("a batch repeats or misses keys")
    for p in parts[1:]:
        out = out.join(p, on)
    if out.count() != n:
        raise ValueError("batches don't cover the same keys")
    return out


def align(parts: list[DataFrame], key: str, coords: list[str]) -> DataFrame:
    """Rows that every table has, on one key; a shared row whose coordinates differ, or a repeated key, is an error.

    Tables without some of the coordinates aren't compared on them.
    """
    for p in parts:
        if not p.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{key} repeats")
    out = parts[0]
    for n, p in enumerate(parts[1:]):
        shared = [c for c in coords if c in p.columns and c in out.columns]
        p = p.withColumnsRenamed({c: f"_{n}_{c}" for c in shared})
        out = out.join(p, key)
        if shared:
            differ = F.lit(False)
            for c in shared:
                differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{n}_{c}"))
            if not out.filter(differ).isEmpty():
                raise ValueError("a row's coordinates differ between tables")
            out = out.drop(*[f"_{n}_{c}" for c in shared])
    return out


def link_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that must find exactly one partner for every row."""
    if not right.groupBy(*on).count().filter("count > 1").isEmpty() or not left.join(right, on, "left_anti").isEmpty():
        raise ValueError("keys aren't matched one to one")
    return left.join(right, on)


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write where nothing exists yet."""
    df.write.mode("errorifexists").format(fmt).save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of the files below a path, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files whose size or hash differ from a manifest, are missing or are extra; empty if all is well."""
    now = manifest(spark, path)
    both = expected.alias("e").join(now.alias("n"), "file", "full_outer")
    status = F.when(F.col("n.bytes").isNull(), "missing").when(F.col("e.bytes").isNull(), "extra").when((F.col("e.bytes") != F.col("n.bytes")) | (F.col("e.sha256") != F.col("n.sha256")), "changed")
    return both.select("file", status.alias("status")).filter("status is not null")


def task_seed(master: int, index):
    """Seed of a task by its number from 1; the constants are fixed values."""
    return F.pmod(F.lit(master) + index * F.lit(104729), F.lit(2147483646)) + 1


def task_plan(spark: SparkSession, design: dict[str, list], replicates: int, master: int) -> DataFrame:
    """All combinations of a design times replicates, numbered, each with its seed."""
    plan = spark.range(1).drop("id")
    for name, values in design.items():
        plan = plan.crossJoin(F.broadcast(spark.range(len(values)).select(F.element_at(F.from_json(F.lit(json.dumps(values)), T.ArrayType(T.StringType() if isinstance(values[0], str) else T.DoubleType())), F.col("id").cast("int") + 1).alias(name), F.col("id").alias(f"_{name}"))))
    plan = plan.crossJoin(F.broadcast(spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"))))
    index = F.lit(0).cast("long")
    for name, values in design.items():
        index = index * len(values) + F.col(f"_{name}")
    plan = plan.withColumn("task_id", index * replicates + F.col("replicate"))
    return plan.withColumn("seed", task_seed(master, F.col("task_id"))).drop(*[f"_{n}" for n in design])


def run_tasks(plan: DataFrame, path: str, work: Callable, schema: str, signature: str) -> DataFrame:
    """Run the tasks that have no result yet and append theirs; results of another signature are an error.

    ``work`` maps an iterator of pandas frames of tasks to frames of results
    with ``task_id``.  Appends are committed by Spark's writer, so a stopped run
    leaves whole parts only and the next one continues.
    """
    spark = plan.sparkSession
    kind = T._parse_datatype_string(schema + ", signature string")
    try:
        done = spark.read.schema(kind).parquet(path)
        if not done.filter(F.col("signature") != signature).isEmpty():
            raise ValueError("results under this path belong to other data or settings")
        plan = plan.join(done.select("task_id").distinct(), "task_id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    plan.mapInPandas(work, schema).withColumn("signature", F.lit(signature)).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def signature(df: DataFrame, settings: dict) -> str:
    """A hash of a table's rows, whatever their order, and of settings."""
    import hashlib

    rows = df.select(F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
    return hashlib.sha256(json.dumps([rows[0], str(rows[1]), settings], sort_keys=True).encode()).hexdigest()
