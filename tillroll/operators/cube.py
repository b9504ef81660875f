"""Exact distinct counts that merge: a cube of sums and bitmaps.

A distinct count of invoices over March and April is not the sum of the two, so
cards of distinct counts usually go back to the lines.  A bitmap merges: here each
invoice and each customer gets a dense number, and for every cell of the dimensions
the numbers that occur in it are set as bits, 32,768 to a block of 4 KB.  Any choice
of cells, and any grouping of them, is answered by uniting blocks and counting bits:
exact, and from a table whose size goes with things and cells, not with lines.

Numbers are dealt in the order of the cell a thing first occurs in, so the things of
a cell share few blocks.  Invoices mostly live in one cell; a customer has one bit in
each cell they bought in.

Building takes one pass over the lines: they are summed per (things, cell) first,
that table is written, and everything else reads it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.ranking import global_rank
from tillroll.storage import fresh_path, written


@dataclass
class Cube:
    """``cells``: one row per cell with its sums.  ``blocks``: (thing, cell, block, bits)."""

    dims: list[str]
    sums: list[str]
    things: list[str]
    cells: DataFrame
    blocks: DataFrame

    def ask(self, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
        """Sums and distinct counts of the cells in ``where``, per value of the dimensions ``by`` (or one row)."""
        by = list(by)
        unknown = set(by) - set(self.dims)
        if unknown:
            raise ValueError(f"the cube has no {sorted(unknown)}, only {self.dims}")
        cells, blocks = (self.cells, self.blocks) if where is None else (self.cells.where(where), self.blocks.where(where))
        united = blocks.groupBy(*by, "thing", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        counts = united.groupBy(*by).agg(*[
            F.coalesce(F.sum(F.when(F.col("thing") == t, F.bitmap_count("bits"))), F.lit(0)).cast("long").alias(t) for t in self.things
        ])
        sums = cells.groupBy(*by).agg(*[F.sum(s).alias(s) for s in self.sums])
        if not by:
            return sums.crossJoin(F.broadcast(counts))
        named = counts.withColumnsRenamed({d: f"__{d}" for d in by})
        same = [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in by]
        counted = [F.coalesce(F.col(t), F.lit(0)).cast("long").alias(t) for t in self.things]
        return sums.join(named, same, "left").select(*by, *self.sums, *counted)

    def save(self, path: str) -> None:
        root = path.rstrip("/")
        self.cells.write.mode("overwrite").parquet(f"{root}/cells")
        self.blocks.write.mode("overwrite").parquet(f"{root}/blocks")

    @staticmethod
    def load(spark: SparkSession, path: str, dims: Sequence[str], sums: Sequence[str], things: Sequence[str]) -> Cube:
        root = path.rstrip("/")
        return Cube(list(dims), list(sums), list(things), spark.read.parquet(f"{root}/cells"), spark.read.parquet(f"{root}/blocks"))


def build_cube(lines: DataFrame, dims: Sequence[str], things: Mapping[str, str], sums: Mapping[str, str]) -> Cube:
    """``things``: name of a distinct count -> column; ``sums``: name of a sum -> column of whole or exact numbers.

    A null thing is not counted, as by ``COUNT(DISTINCT)``; a null dimension is a cell of its own.
    """
    dims, spark = list(dims), lines.sparkSession
    added = {s: F.sum(c).alias(s) for s, c in sums.items()}
    base = written(lines.groupBy(*dict.fromkeys(things.values()), *dims).agg(*added.values()), "cube-base")
    blocks = None
    for name, column in things.items():
        met = base.where(F.col(column).isNotNull()).select(F.col(column).alias("it"), *dims).distinct()
        first = met.groupBy("it").agg(F.min(F.struct(*dims)).alias("at"))
        ids = global_rank(first, [F.col("at"), F.col("it")], rank_col="id").select(F.col("it").alias("__it"), "id")
        placed = met.join(ids, F.col("it") == F.col("__it"))
        bits = placed.groupBy(*dims, F.bitmap_bucket_number("id").alias("block")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
        ).withColumn("thing", F.lit(name))
        blocks = bits if blocks is None else blocks.unionByName(bits)
    cells = base.groupBy(*dims).agg(*[F.sum(s).alias(s) for s in sums])
    path = fresh_path(spark, "cube")
    Cube(dims, list(sums), list(things), cells, blocks).save(path)
    return Cube.load(spark, path, dims, list(sums), list(things))
