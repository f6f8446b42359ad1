"""Entity-attribute-value rows into wide tables by position (problem 4).

Method: one pass lists the attributes and estimates how many entities there are. Entities are spread over blocks by
hash; they are counted per block, so that every block has its range of global ordinals without being built first. Repeated readings
of a cell are pre-aggregated (map-side first); in each block every attribute is a typed column vector filled by ordinal,
and the vectors are put side by side by position. A block holds a bounded number of cells: of its entities each has at
most one cell per attribute, so that no entity, however often repeated, fills a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import cut

#: Cells of a block when all are filled, by expectation, the most entities of a block, and the widest table that is built.
BLOCK_CELLS, BLOCK_ENTITIES, MOST_ATTRIBUTES = 4_000_000, 2048, 20_000


def attribute_columns(pairs: list[tuple[str | None, str | None]]) -> list[tuple[str | None, str | None, str]]:
    """(panel, assay, column name) in order of panel and assay; names are plain and differ without regard to case."""
    taken, out = set(), []
    for panel, assay in sorted(pairs, key=lambda p: (p[0] is None, p[0] or "", p[1] is None, p[1] or "")):
        base = re.sub(r"[^0-9a-z]+", "_", f"{panel if panel is not None else 'no_panel'}__{assay if assay is not None else 'no_assay'}".lower()).strip("_") or "unnamed"
        name, k = base, 2
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name)
        out.append((panel, assay, name))
    return out


def cells(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per cell: last usable reading, whether usable readings differ, and warnings of the last reading.

    rows: ``value, usable, qc_warning, assay_warning, loaded_at, row_id`` and the keys of a cell. Where no reading is
    usable the last one with a number is kept; its warning stays beside it.
    """
    order = F.struct(F.col("usable").alias("u"), F.col("value").isNotNull().alias("v"), F.col("loaded_at").alias("t"), F.col("row_id").alias("r"))
    good = F.when(F.col("usable"), F.col("value"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct("value", "qc_warning", "assay_warning"), order).alias("last"), (F.min(good) != F.max(good)).alias("differ"))


def _ranks(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """For each row the rank of its text among the column's distinct ones, null last, and these in order."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    return rank[coded.indices.to_numpy()], [names[i] for i in order]


def _by_row(pos: np.ndarray, index: np.ndarray, there: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """List offsets by entity, attribute numbers in order, and which rows they come from."""
    at = np.flatnonzero(there)
    at = at[np.lexsort((index[at], pos[at]))]
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(pos[at], minlength=n))]), pa.int32()), pa.array(index[at], pa.int32()), at


def _build_block(n_attributes: int):
    def build(table: pa.Table) -> pa.Table:
        index = table.column("ordinal_attribute").to_numpy()
        entity, entities = _ranks(table.column("entity"))
        file, files = _ranks(table.column("file"))
        here, pos = np.unique(entity * len(files) + file, return_inverse=True)  # in order of entity, then file
        n = len(here)
        matrix = np.full((n_attributes, n), np.nan)
        matrix[index, pos] = table.column("value").to_numpy(zero_copy_only=False).astype(float)
        warned = []
        for c in ("qc_warning", "assay_warning"):
            text = table.column(c).combine_chunks()
            offsets, numbers, at = _by_row(pos, index, text.is_valid().to_numpy(zero_copy_only=False), n)
            warned.append(pa.MapArray.from_arrays(offsets, numbers, text.take(pa.array(at))))
        offsets, numbers, _ = _by_row(pos, index, table.column("differ").to_numpy(zero_copy_only=False).astype(bool), n)
        block = table.column("block")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array([entities[k] for k in here // len(files)], pa.string()), pa.array([files[k] for k in here % len(files)], pa.string()),
             *warned, pa.ListArray.from_arrays(offsets, numbers), *(pa.array(v, pa.float64(), mask=np.isnan(v)) for v in matrix)],
            ["block", "place", "entity", "file", "qc_at", "assay_at", "differ_at", *(f"a{i}" for i in range(n_attributes))])

    return build


class Plan:
    """What is known before building: attribute columns and the number of blocks, from one pass over the rows."""

    def __init__(self, rows: DataFrame) -> None:
        # a sketch of the entities beside each attribute: together they tell how many there are
        seen = cut(rows.groupBy("panel", "assay").agg(F.hll_sketch_agg(F.xxhash64("entity", "file"), 9).alias("s")))
        pairs = seen.select("panel", "assay").limit(MOST_ATTRIBUTES + 1).collect()
        if len(pairs) > MOST_ATTRIBUTES:
            raise ValueError(f"more than {MOST_ATTRIBUTES} attributes: no wide table can hold them")
        self.columns = attribute_columns([(r["panel"], r["assay"]) for r in pairs])
        n = (seen.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n")).first()["n"] or 0) if pairs else 0
        per_block = max(1, min(BLOCK_ENTITIES, BLOCK_CELLS // max(1, len(self.columns))))
        self.n_blocks = max(1, -(-n // per_block))

    def block(self):
        return F.pmod(F.xxhash64("entity", "file"), F.lit(self.n_blocks))

    def offsets(self, rows: DataFrame) -> DataFrame:
        """Each block's first ordinal, from the entities alone; one row per some thousands of entities."""
        sizes = rows.select("entity", "file").distinct().groupBy(self.block().alias("block")).agg(F.count(F.lit(1)).alias("n"))
        return sizes.select(F.col("block").alias("_block"), (F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))


def stitch(rows: DataFrame, plan: Plan) -> DataFrame:
    """Wide rows by block and place, attributes as a0, a1, ..., warnings and conflicts by attribute number."""
    named = rows.sparkSession.createDataFrame([(p, a, i) for i, (p, a, _) in enumerate(plan.columns)], "p string, a string, ordinal_attribute int")
    # the attribute list is bounded by MOST_ATTRIBUTES
    numbered = rows.join(F.broadcast(named), F.col("panel").eqNullSafe(F.col("p")) & F.col("assay").eqNullSafe(F.col("a"))).drop("panel", "assay", "p", "a")
    long = cells(numbered, "entity", "file", "ordinal_attribute").select(plan.block().alias("block"), "entity", "file", "ordinal_attribute", "last.*", F.coalesce("differ", F.lit(False)).alias("differ"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.LongType()), T.StructField("entity", T.StringType()), T.StructField("file", T.StringType()),
                           T.StructField("qc_at", T.MapType(T.IntegerType(), T.StringType())), T.StructField("assay_at", T.MapType(T.IntegerType(), T.StringType())),
                           T.StructField("differ_at", T.ArrayType(T.IntegerType())), *(T.StructField(f"a{i}", T.DoubleType()) for i in range(len(plan.columns)))])
    return long.groupBy("block").applyInArrow(_build_block(len(plan.columns)), schema)


def wide_table(rows: DataFrame) -> DataFrame:
    """One row per entity and file with global ordinal, one numeric column per attribute and both kinds of warnings.

    Warnings other than PASS are maps from column name to text; ``conflicts`` names the columns whose usable readings
    differ (the last loaded one is shown). Rows without entity are left out; a null file, panel or assay is a value of
    its own; an empty input gives an empty table without attribute columns.
    """
    plan = Plan(rows)
    columns = plan.columns
    wide = stitch(rows, plan).join(plan.offsets(rows), F.col("block") == F.col("_block"))
    names = F.array(*(F.lit(c) for _, _, c in columns)) if columns else F.array().cast("array<string>")
    named = lambda m: F.transform_keys(m, lambda k, _: F.element_at(names, k + 1))
    return wide.select(
        (F.col("offset") + F.col("place")).alias("entity_ordinal"), F.col("entity").alias("sample_id"), F.col("file").alias("source_file"),
        *(F.col(f"a{i}").alias(c) for i, (_, _, c) in enumerate(columns)),
        named(F.col("qc_at")).alias("qc_warnings"), named(F.col("assay_at")).alias("assay_warnings"),
        F.transform("differ_at", lambda k: F.element_at(names, k + 1)).alias("conflicts"))


def conflicting_cells(rows: DataFrame) -> DataFrame:
    """Cells with two or more usable readings that differ, read off the stitched blocks."""
    plan = Plan(rows)
    named = F.broadcast(rows.sparkSession.createDataFrame([(i, p, a) for i, (p, a, _) in enumerate(plan.columns)], "i int, panel string, assay string"))
    hit = stitch(rows, plan).select("entity", "file", F.explode("differ_at").alias("i"))
    return hit.join(named, "i").select(F.col("entity").alias("sample_id"), F.col("file").alias("source_file"), "panel", "assay")
