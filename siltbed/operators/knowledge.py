"""A cube of knowledge nodes: three named axes of levels, nodes at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed colours by level of the first axis, and the one beyond.
COLOURS = ("#ff6b6b", "#4ecdc4", "#45b7d1", "#96ceb4")
DEFAULT_COLOUR = "#aaaaaa"


def with_levels(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """nodes (x, y, z) with the level names of levels (axis, idx, name); an index without a level gives null."""
    for axis in ("x", "y", "z"):
        one = levels.where(F.col("axis") == axis).select(F.col("idx").alias(axis), F.col("name").alias(f"{axis}_level"))
        nodes = nodes.join(one, axis, "left")
    return nodes


def matrix(nodes: DataFrame, levels: DataFrame, rows: str = "x", columns: str = "y") -> DataFrame:
    """A row per pair of levels with its node count and the title of its first node; empty cells stay.

    Only the level lists, whose size is the cube's, are crossed.
    """
    of = lambda axis: levels.where(F.col("axis") == axis).select(F.col("idx").alias(axis), F.col("name").alias(f"{axis}_level"))
    cells = nodes.groupBy(rows, columns).agg(F.count("*").alias("n"), F.min_by("title", "id").alias("title"))
    return of(rows).crossJoin(of(columns)).join(cells, [rows, columns], "left").na.fill(0, ["n"])


def cell(nodes: DataFrame, x: int, y: int, z: int) -> DataFrame:
    return nodes.where((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z))


def view_of(*active: Column) -> tuple[Column, Column]:
    """How many axes are active, and the view for it: a cube for three, a matrix for two."""
    n = sum((a.cast("int") for a in active[1:]), active[0].cast("int"))
    return n, F.when(n == 3, "cube").when(n == 2, "matrix").otherwise("none")
