"""Delimited text scans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def scan_raw(spark: SparkSession, path: str | list[str], names: Sequence[str]) -> DataFrame:
    """Headerless ``|`` text as strings: surplus fields are cut, missing ones are NULL.

    Files are read in splits, so no file is ever held whole by one task.
    """
    return (spark.read.schema(text_schema(names))
            .option("sep", "|").option("header", False).option("mode", "PERMISSIVE").csv(path))


def read_predictions(spark: SparkSession, path: str, prob_col: str,
                     id_col: str = "loan_seq_num", id_type: str = "string") -> DataFrame:
    schema = f"{id_col} {id_type}, {prob_col} double"
    return spark.read.schema(schema).option("header", True).csv(path)


def read_survival_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None
                        ) -> DataFrame:
    """CSV (with header and a given schema) or Parquet, by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "csv":
        if schema is None:
            raise ValueError("a csv table needs its schema; it is not inferred")
        return spark.read.schema(schema).option("header", True).csv(path)
    raise ValueError(f"'{suffix}' is no known kind of table file (csv, parquet)")


VINTAGE_NAME = r"(\d{4})Q([1-4])"


def with_file_vintage(df: DataFrame, pattern: str = VINTAGE_NAME) -> DataFrame:
    """Vintage year and quarter from the name of the file each row came from; a name without them is
    an error."""
    name = F.col("_metadata.file_name")
    part = lambda i: F.when(F.regexp_extract(name, pattern, i) != "",
                            F.regexp_extract(name, pattern, i)).otherwise(
        F.raise_error(F.concat(F.lit("no quarter in the file name "), name))).cast("int")
    return df.withColumns({"vintage_year": part(1), "vintage_quarter": part(2)})


def quarter_files(spark: SparkSession, path: str | list[str], pattern: str = VINTAGE_NAME
                  ) -> dict[str, tuple[int, int]]:
    """Vintage by file path, from a listing that opens no file."""
    found = spark.read.format("binaryFile").load(path).select("path").collect()
    out = {}
    for row in found:
        quarter = re.search(pattern, row["path"].rsplit("/", 1)[-1])
        if quarter is None:
            raise ValueError(f"no quarter in the file name {row['path']}")
        out[row["path"]] = int(quarter[1]), int(quarter[2])
    return out
