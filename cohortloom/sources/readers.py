"""Readers for delimited, JSON and workbook files with the quirks of hand-made sheets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_header(name: str) -> str:
    """Trimmed, lower case, blanks as underscores, ``_-_`` as one."""
    return re.sub(r"\s+", "_", name.strip().lower()).replace("_-_", "_")


def normal_headers(df: DataFrame) -> DataFrame:
    """All headers in normal form; headers that become equal are told apart by a number."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        n = normal_header(c)
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*out)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, sep: str = ",", provenance: str | None = None) -> DataFrame:
    """CSV with header; text columns unless a schema is given, so that no file is read twice. Globs and lists of paths are one table."""
    r = spark.read.option("header", True).option("sep", sep)
    df = (r.schema(schema) if schema else r).csv(path)
    return df.withColumn(provenance, F.col("_metadata.file_path")) if provenance else df


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator most frequent in the first line: tab, semicolon or comma."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(("\t", ";", ","), key=lambda s: (line.count(s), s == ","))


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, sep=sniff_separator(spark, path))


def read_indexed(spark: SparkSession, path: str, index: str = "SampleID") -> DataFrame:
    """CSV whose first column is an index without a name."""
    df = read_csv(spark, path)
    return df.withColumnRenamed(df.columns[0], index)


def read_two_headers(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV whose names stand in two rows: upper and lower name are joined by an underscore, a blank upper one repeats."""
    raw = spark.read.option("sep", sep).csv(path)
    head = raw.limit(2).collect()
    if len(head) < 2:
        return raw.limit(0)
    names, upper = [], ""
    for a, b in zip(head[0], head[1], strict=True):
        upper = a or upper
        names.append(normal_header(f"{upper}_{b}" if b else upper) or f"column_{len(names)}")
    same = F.lit(False)
    for row in head:
        hit = F.lit(True)
        for c, v in zip(raw.columns, row, strict=True):
            hit = hit & F.col(c).eqNullSafe(F.lit(v))
        same = same | hit
    return raw.where(~same).toDF(*names)


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.lower().startswith("unnamed")))


def columns_like(df: DataFrame, prefixes: tuple[str, ...] = (), numeric: bool = False) -> list[str]:
    """Names by prefix, optionally numeric ones only."""
    return [f.name for f in df.schema.fields if (not prefixes or f.name.startswith(prefixes)) and (not numeric or isinstance(f.dataType, T.NumericType))]


def insert_after(df: DataFrame, after: str, name: str, value) -> DataFrame:
    cols: list = []
    for c in df.columns:
        cols.append(F.col(f"`{c}`"))
        if c == after:
            cols.append(value.alias(name))
    return df.select(*cols)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def bundle(areas: DataFrame, features: DataFrame, samples: DataFrame, row: str, column: str) -> DataFrame:
    """Areas by row and column number with the labels of both, joined by number; refused if areas have a number that
    no label has, or labels one that no area has.

    Numbers are given when the files are read, so that no order of rows is relied on.
    """
    for labels, at in ((features, row), (samples, column)):
        have, want = areas.agg(F.countDistinct(at).alias("n"), F.max(at).alias("most")).first(), labels.agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("most")).first()
        if (have["n"], have["most"]) != (want["n"], want["most"]):
            raise ValueError(f"{at}: areas have {have['n']} up to {have['most']}, labels {want['n']} up to {want['most']}")
    return areas.join(features, row).join(samples, column)


def without_first(df: DataFrame, order: str) -> DataFrame:
    """Without the first row by order (a repeated header), unless it is the only one."""
    first = df.agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(first), (F.col(order) > F.col("_first")) | (F.col("_n") == 1)).drop("_first", "_n")


def read_below(spark: SparkSession, path: str, names: list[str], skip: int, sep: str = ",") -> DataFrame:
    """Delimited text below ``skip`` lines of one file, columns by given names. Lines are told apart by their place in
    the file, so that lines like those skipped stay."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where((F.col("at") >= skip) & (F.trim("line") != ""))
    return lines.select(F.from_csv("line", ", ".join(f"`{n}` string" for n in names), {"sep": sep}).alias("r")).select("r.*")
