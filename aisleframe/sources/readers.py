"""Readers for scanner files, dimension files and model panels."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleframe.sources import schemas


#: Files whose first line is looked up at a time.
LOOKUPS = 16


def _layouts(spark: SparkSession, paths: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the column names of their first line. Only that line of each file is read here.

    The number of files is that of categories and years, so their names fit the driver.
    """
    folder = paths if isinstance(paths, str) else list(paths)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = sorted(map(unquote, listed.inputFiles()))
    with ThreadPool(LOOKUPS) as pool:
        first = pool.map(lambda file: spark.read.text(file).first(), files)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, first, strict=True):
        if line is not None:
            layouts.setdefault(tuple(next(csv.reader([line.value], delimiter="\t"))), []).append(file)
    return layouts


def _tsv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Tab-separated files with a header, each with its own order of columns; further columns are ignored.

    Files with the same header are one scan; the scans are put together by name. A file without one of the
    columns ends the job with its name; an empty file contributes nothing.
    """
    scans = []
    for names, files in _layouts(spark, paths).items():
        missing = [f.name for f in schema.fields if f.name not in names]
        if missing:
            raise ValueError(f"{files[0]} has no column {', '.join(missing)}")
        text = T.StructType([T.StructField(name, T.StringType()) for name in names])
        lines = spark.read.schema(text).option("sep", "\t").option("header", True).csv(files)
        scans.append(lines.select(
            *[_typed(f.name, f.dataType.simpleString()).alias(f.name) for f in schema.fields],
            F.col("_metadata.file_path").alias("_file"),
        ))
    if not scans:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_file", T.StringType())]))
    return reduce(DataFrame.unionByName, scans)


def _typed(name: str, kind: str) -> Column:
    """The field as its type; a value that is none of that type ends the job with its file."""
    return F.expr(
        f"CASE WHEN `{name}` IS NOT NULL AND try_cast(`{name}` AS {kind}) IS NULL THEN CAST(raise_error("
        f"concat('{name} is no {kind}: ', `{name}`, ' in ', _metadata.file_name)) AS {kind}) "
        f"ELSE try_cast(`{name}` AS {kind}) END"
    )


def read_movement(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Weekly movement files CCCC_YYYY.tsv; category and year come from the name of the file or its folder.

    Category-years without a file contribute no rows.
    """
    tag = r"(\d{4})_(\d{4})[^/]*(?:/[^/]*)?$"
    return _tsv(spark, paths, schemas.MOVEMENT).select(
        "*",
        F.regexp_extract("_file", tag, 1).alias("group"),
        F.regexp_extract("_file", tag, 2).cast("int").alias("year"),
    ).drop("_file")


def read_stores(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Yearly store files, stacked, four columns."""
    return _tsv(spark, paths, schemas.STORES).drop("_file")


def read_upc_versions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Yearly product-version files, stacked."""
    return _tsv(spark, paths, schemas.UPC_VERSIONS).drop("_file").withColumnRenamed("panel_year", "year")


def read_extras(spark: SparkSession, path: str) -> DataFrame:
    """Product attributes by upc and year; the second size code is the one in use."""
    extras = spark.read.parquet(path)
    if "size2_code" in extras.columns:
        extras = extras.drop("size_code").withColumnRenamed("size2_code", "size_code")
    return extras


def read_tax_rates(spark: SparkSession, path: str) -> DataFrame:
    """State by year tax table as CSV (Stata files are converted once, outside Spark)."""
    return spark.read.csv(path, header=True, schema=schemas.TAX_RATES)


def read_panel(spark: SparkSession, path: str, solved: bool = False) -> DataFrame:
    """Firm by year by state parameter panel, with solved prices when they are in the file."""
    schema = schemas.SOLVED_PANEL if solved else schemas.FIRM_PANEL
    return spark.read.csv(path, header=True, schema=schema)


def read_trade_costs(spark: SparkSession, path: str) -> DataFrame:
    """Trade costs by pair of states."""
    return spark.read.csv(path, header=True, schema=schemas.TRADE_COSTS)


def write_panel(df: DataFrame, path: str) -> None:
    """CSV sink of the model panels."""
    df.write.mode("overwrite").csv(path, header=True)


def categories(movement: DataFrame) -> DataFrame:
    """Distinct category codes."""
    return movement.select("group").distinct()
