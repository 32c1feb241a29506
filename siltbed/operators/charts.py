"""Chart shapes: ordered categories, series, aligned matrices, ranges, stacks and downsampling."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.ranks import between_percents, running_sum

STAMP = "yyyy-MM-dd HH:mm:ss"


def series(history: DataFrame) -> DataFrame:
    """type, status, data: the counts of each series, latest first."""
    ordered = F.sort_array(F.collect_list(F.struct("created_at", "rcd_count")), asc=False)
    return history.groupBy("type", "status").agg(F.transform(ordered, lambda x: x["rcd_count"]).alias("data"))


def categories(history: DataFrame) -> DataFrame:
    """type, categories: the distinct times of each chart, latest first."""
    times = F.sort_array(F.collect_set("created_at"), asc=False)
    return history.groupBy("type").agg(F.transform(times, lambda t: F.date_format(t, STAMP)).alias("categories"))


def aligned(history: DataFrame, statuses: list[str]) -> DataFrame:
    """A row per type and time with a column per status; a status missing at a time counts 0."""
    return history.groupBy("type", "created_at").pivot("status", statuses).sum("rcd_count").na.fill(0, statuses)


def every_time(history: DataFrame, most: int = 10_000) -> DataFrame:
    """type, status and created_at: every series at every time that any series has, for alignment; at most so many series."""
    series = [tuple(r) for r in history.select("type", "status").distinct().limit(most + 1).collect()]
    if len(series) > most:
        raise ValueError(f"more than {most} series")
    kind = history.select("type", "status").schema.simpleString()
    of = F.from_json(F.lit(json.dumps([{"type": t, "status": s} for t, s in series])), f"array<{kind}>")
    return history.select("created_at").distinct().select("created_at", F.explode(of).alias("x")).select("x.type", "x.status", "created_at")


def last_days(df: DataFrame, column: str, days: int, reference: str) -> DataFrame:
    return df.where(F.col(column).cast("date") >= F.date_sub(F.lit(reference).cast("date"), days))


def stacked(df: DataFrame, x: str, by: str, value: str) -> DataFrame:
    """Each series' value with the base and top of its band at x."""
    top = F.sum(value).over(Window.partitionBy(x).orderBy(by))
    return df.select(x, by, value, (top - F.col(value)).alias("base"), top.alias("top"))


def zoom(df: DataFrame, by: str, order: str, low: float, high: float) -> DataFrame:
    """Rows of each series between two percentages of its length; a long series is spread over many tasks."""
    return between_percents(df, by, order, low, high)


def largest_triangles(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Places of at most n points that keep the shape of a line (Steinarsson 2013)."""
    if n >= len(x) or n < 3:
        return np.arange(len(x))
    edges = 1 + np.arange(n - 1) * (len(x) - 2) // (n - 2)
    kept = [0]
    for i in range(n - 2):
        a, b = edges[i], edges[i + 1]
        c = (b, edges[i + 2]) if i + 2 < len(edges) else (len(x) - 1, len(x))
        cx, cy = x[c[0] : c[1]].mean(), y[c[0] : c[1]].mean()
        p = kept[-1]
        area = np.abs((x[p] - cx) * (y[a:b] - y[p]) - (x[p] - x[a:b]) * (cy - y[p]))
        kept.append(a + int(np.argmax(area)))
    return np.array([*kept, len(x) - 1])


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (a row each of x and y), ordered by x and y."""
    points = np.unique(points, axis=0)
    chains = []
    for side in (1, -1):
        chain = []
        for p in points.tolist():
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2:]
                if side * ((bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)) > 0:
                    break
                chain.pop()
            chain.append(p)
        chains += chain
    return np.unique(np.array(chains).reshape(-1, 2), axis=0)


def _corners(g: pd.DataFrame) -> pd.DataFrame:
    corners = hull(g[["x", "y"]].to_numpy(float))
    return g.iloc[[0] * len(corners)].assign(x=corners[:, 0], y=corners[:, 1])


def _triangles(n: int):
    """Picks the points of one series from the corners of its buckets, which stand in the order of their numbers."""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["bucket", "x", "y"], kind="stable").reset_index(drop=True)
        total = g["total"].iloc[0]
        if total <= n:
            return g.loc[g.index.repeat(g["copies"]), ["by", "x", "y"]]
        buckets = [b for _, b in g.groupby("bucket")]
        kept = [buckets[0].iloc[0]]
        for b, after in zip(buckets[1:-1], buckets[2:], strict=True):
            cx, cy, p = after["cx"].iloc[0], after["cy"].iloc[0], kept[-1]
            x, y = b["x"].to_numpy(), b["y"].to_numpy()
            area = np.abs((p["x"] - cx) * (y - p["y"]) - (p["x"] - x) * (cy - p["y"]))
            kept.append(b.iloc[int(np.argmax(area))])
        kept.append(buckets[-1].iloc[0])
        return pd.DataFrame(kept)[["by", "x", "y"]]

    return pick


def downsample(df: DataFrame, by: str, x: str, y: str, n: int, cell_rows: int = 100_000) -> DataFrame:
    """At most n points of each series that keep its shape, as largest_triangles() picks them; x and y as doubles.

    Points get their place in the series from counts of cells, equal ranges of x of about cell_rows points, so a series
    is sorted in parts; points crowded in a small range of x are one part's. A triangle's area is largest at a corner of the convex hull of a bucket's points, so the
    corners of each part, then of each bucket, are all that the walk along a series reads: n small groups.
    A bucket's mean is the sum of its points over their number. Points where x or y is null or NaN are left out; a null
    series is one of its own. All points of a series with n or fewer, and equal points there, are kept; n is at least 3.
    """
    if n < 3:
        raise ValueError("n must be 3 or more")
    p = df.select(F.col(by).alias("by"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x = x AND y = y AND NOT isnan(x) AND NOT isnan(y)")
    size = p.groupBy("by").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("total"))
    cells = F.floor(F.col("total") / cell_rows) + 1
    at = F.coalesce(F.floor((F.col("x") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * cells), F.lit(0)).cast("long")
    p = p.join(size.withColumnRenamed("by", "of"), F.col("by").eqNullSafe(F.col("of"))).select("by", "x", "y", "total", at.alias("cell"))
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counts = p.groupBy(F.col("by").alias("of"), F.col("cell").alias("at")).agg(F.count("*").alias("k"))
    counts = counts.select("of", "at", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    p = p.join(counts, F.col("by").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at"))).drop("of", "at")
    place = F.col("start") + F.row_number().over(Window.partitionBy("by", "cell").orderBy("x", "y")) - 1
    inner = F.expr(f"(place * {n - 2} - 1) div (total - 2)") + 1
    bucket = F.when((F.col("total") <= n) | (F.col("place") == 0), F.lit(0)).when(F.col("place") == F.col("total") - 1, F.lit(n - 1)).otherwise(inner)
    p = p.withColumn("place", place).withColumn("bucket", bucket.cast("int"))
    p = p.select("by", "cell", "bucket", "total", "x", "y")
    all_of = p.where(F.col("total") <= n).groupBy("by", "bucket", "total", "x", "y").agg(F.count("*").alias("copies"))
    many = p.where(F.col("total") > n)
    mean = many.groupBy(F.col("by").alias("of"), F.col("bucket").alias("at")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    corners = many.groupBy("by", "cell", "bucket").applyInPandas(_corners, many.schema)
    corners = corners.groupBy("by", "bucket").applyInPandas(_corners, many.schema)
    corners = corners.join(mean, F.col("by").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    none = F.lit(None).cast("double")
    read = corners.select("by", "bucket", "total", "x", "y", "cx", "cy", F.lit(1).cast("long").alias("copies"))
    read = read.unionByName(all_of.select("by", "bucket", "total", "x", "y", none.alias("cx"), none.alias("cy"), "copies"))
    return read.groupBy("by").applyInPandas(_triangles(n), read.select("by", "x", "y").schema).select(F.col("by").alias(by), F.col("x").alias(x), F.col("y").alias(y))


def random_walk(rows: DataFrame, number: str, seed: int, *order: str) -> DataFrame:
    """rows with day and v: v is the v before plus noise in [-10, 10), rounded; the first is a random value below 300.

    A row's noise follows from the seed and its number by a digest, so it does not depend on partitions. number counts
    from 0 and order is total; a day passes with each number.
    """
    i = F.col(number)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    step = F.when(i == 0, F.floor(u * 300)).otherwise(F.floor((u - 0.5) * 20 + 0.5))
    walked = running_sum(rows.withColumn("_step", step), "_step", *order)
    return walked.withColumn("day", F.date_add(F.lit("1968-10-04").cast("date"), i.cast("int"))).withColumnRenamed("total", "v").drop("_step")
