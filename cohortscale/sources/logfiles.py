"""Log files: append-only JSON Lines, and telemetry CSV that never fails on a bad row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscale.schemas import TELEMETRY, struct


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_telemetry(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_telemetry(spark: SparkSession, path: str, schema: str = TELEMETRY) -> DataFrame:
    """Rows padded or trimmed to the columns; a value that does not parse is NULL, never an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option(
        "enforceSchema", True
    ).csv(path)


def parse_telemetry(lines: DataFrame, schema: str = TELEMETRY) -> DataFrame:
    """Telemetry out of CSV lines (value), in batch or as a stream, with the ``malformed`` line where it was one.

    A line with too few cells is padded with NULL, one with too many is trimmed, a cell that does not parse is NULL; each
    such line is kept beside what could be read of it. Header lines are left out wherever they stand.
    """
    fields = [f.name for f in struct(schema)]
    read = F.from_csv("value", f"{schema}, malformed STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"})
    rows = lines.filter((F.trim("value") != "") & (F.col("value") != ",".join(fields)))
    return rows.select(read.alias("r")).select("r.*")


def telemetry_columns() -> list[str]:
    return [f.name for f in struct(TELEMETRY)]


def pad_or_trim(line: str = "value", columns: int | None = None):
    """A CSV line as an array of exactly the expected number of cells."""
    n = columns or len(telemetry_columns())
    cells = F.split(line, ",", -1)
    empty = F.array_repeat(F.lit(""), n)
    return F.slice(F.concat(cells, empty), 1, n)
