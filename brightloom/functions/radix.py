"""Exact quantiles and Kolmogorov-Smirnov distances by radix selection, without moving the values.

Numbers are counted in cells that keep their order: first 64 cells per power of
two, then 4,096 equal parts of a cell. Only cells that can hold an answer are
looked into again, and only what is left after two rounds is compared value by
value: about a value in 100,000 of a continuous column. Every round is one pass
over the rows that counts on the map side, so what is shuffled depends on the
number of cells, not on rows or distinct values. The small tables between the
rounds are written to the shared folder, so Spark knows their size and joins
the rows with them in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightloom.session import materialised

#: Cells per power of two, and parts of a cell in the second round.
PER_OCTAVE, PARTS = 64, 4096
_OUTER = 1 << 20  # beyond all cells of finite numbers


def cell_of(value: Column) -> Column:
    """Cell number of a double: never falls as the value grows; zero is 0, infinite and missing numbers lie outside."""
    size = F.abs(value)
    level = F.floor((F.log2(size) + 1080) * PER_OCTAVE) + 1
    positive = F.when(F.isnan(value), F.lit(_OUTER + 1)).when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(_OUTER)).otherwise(level)
    return F.when(value < 0, -positive).otherwise(positive).cast("int")


def part_of(value: Column, low: Column, high: Column) -> Column:
    """Which of the equal parts of a cell between its extremes ``low`` < ``high``."""
    return F.least(F.floor((value - low) / (high - low) * PARTS), F.lit(PARTS - 1)).cast("int")


def _rows(df: DataFrame, keys: Sequence[str], value: str, weight: str | None) -> DataFrame:
    known = df.where(F.col(value).isNotNull())
    v = F.col(value).cast("double")
    return known.select(*keys, v.alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"), cell_of(v).alias("_c"))


_COUNTED = (F.sum, "_w", "_n"), (F.min, "_v", "_lo"), (F.max, "_v", "_hi")


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[f(c).alias(to) for f, c, to in _COUNTED])


# --- quantiles ------------------------------------------------------------------------


def _wanted(probs: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """Lower rank, upper rank (from 0) and the upper one's share, per probability."""
    out = []
    for p in probs:
        at = (F.col("_total") - 1) * F.lit(float(p))
        out.append((F.floor(at), F.ceil(at), at - F.floor(at)))
    return out


def _holds(rank: Column) -> Column:
    return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))


def _hit(cells: DataFrame, within: Sequence[str], order: str, probs: Sequence[float]) -> DataFrame:
    """Cells that hold a wanted rank; ``_before`` grows by the cells before them."""
    earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    ranks = [_holds(r) for low, high, _ in _wanted(probs) for r in (low, high)]
    any_ = ranks[0]
    for r in ranks[1:]:
        any_ = any_ | r
    return counted.where(any_)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles of the non-null values: one row per key with an array ``quantiles``.

    ``weight`` names a column that says how often a row counts. Rows with a null
    key are left out; a table without values gives no rows.
    """
    by = list(keys) or ["_all"]
    rows = _rows(df if keys else df.withColumn("_all", F.lit(1)), by, value, weight)
    if keys:
        rows = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    whole = Window.partitionBy(*by)
    coarse = _counted(rows, *by, "_c").withColumns({"_total": F.sum("_n").over(whole), "_before": F.lit(0).cast("long")})
    first = materialised(_hit(coarse, by, "_c", probs), "quantile-cells")

    carried = [*by, "_c", "_before", "_total"]
    inside = rows.join(first.where("_lo < _hi").select(*carried, F.col("_lo").alias("_from"), F.col("_hi").alias("_to")), [*by, "_c"])
    parts = _counted(inside.withColumn("_p", part_of(F.col("_v"), F.col("_from"), F.col("_to"))), *carried, "_p")
    second = materialised(_hit(parts, [*by, "_c"], "_p", probs), "quantile-parts")

    left = second.where("_lo < _hi").select(*carried, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
    last = rows.join(left, [*by, "_c"]).where("_v between _from and _to")
    exact = _hit(_counted(last, *carried, "_from", "_v"), [*by, "_c", "_from"], "_v", probs)

    columns = [*by, "_before", "_n", "_total", "_lo"]
    found = first.where("not (_lo < _hi)").select(*columns).unionByName(second.where("not (_lo < _hi)").select(*columns)).unionByName(exact.select(*columns))
    picks, points = [], []
    for i, (low, high, share) in enumerate(_wanted(probs)):
        picks += [F.max(F.when(_holds(low), F.col("_lo"))).alias(f"_lo{i}"), F.max(F.when(_holds(high), F.col("_lo"))).alias(f"_hi{i}")]
        points.append(F.col(f"_lo{i}") + F.when(share > 0, (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share).otherwise(0.0))
    return found.groupBy(*by, "_total").agg(*picks).select(*keys, F.array(*points).alias("quantiles"))


# --- Kolmogorov-Smirnov ---------------------------------------------------------------


def _gaps(open_: DataFrame, ref: DataFrame, cur: DataFrame, parent: Sequence[str], at: str) -> DataFrame:
    """Both sides' counts per cell ``at`` of the open cells: the gap at the cell's end and the largest possible inside it.

    ``open_`` has what lies before each open cell (r0, c0) and the totals (rt,
    ct) per feature and window.
    """
    keys, carried = ["feature", "window", *parent], ["r0", "c0", "rt", "ct"]
    zero = F.lit(0).cast("long")
    mine = open_.join(ref, ["feature", *parent]).select(*keys, at, *carried, F.col("_n").alias("rn"), zero.alias("cn"))
    theirs = open_.join(cur, keys).select(*keys, at, *carried, zero.alias("rn"), F.col("_n").alias("cn"))
    cells = mine.unionByName(theirs).groupBy(*keys, at, *carried).agg(F.sum("rn").alias("rn"), F.sum("cn").alias("cn"))
    upto = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumns({"r1": F.col("r0") + F.sum("rn").over(upto), "c1": F.col("c0") + F.sum("cn").over(upto)})
    share = lambda n, t: F.col(n) / F.col(t)
    summed = summed.withColumn("gap", F.abs(share("r1", "rt") - share("c1", "ct")))
    summed = summed.withColumns({"r0": F.col("r1") - F.col("rn"), "c0": F.col("c1") - F.col("cn")})
    return summed.withColumn("most", F.greatest(share("r1", "rt") - share("c0", "ct"), share("c1", "ct") - share("r0", "rt")))


def _still_open(cells: DataFrame, best: DataFrame) -> DataFrame:
    """Cells inside which a gap larger than the best one known may lie."""
    return cells.join(best, ["feature", "window"]).where("most > best").drop("best")


def _best(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("feature", "window", "gap")
    for t in tables[1:]:
        out = out.unionByName(t.select("feature", "window", "gap"))
    return out.groupBy("feature", "window").agg(F.max("gap").alias("best"))


def ks_distances(ref: DataFrame, cur: DataFrame, weight: str | None = None) -> DataFrame:
    """``ref(feature, value)``, ``cur(feature, window, value)`` -> (feature, window, ks_statistic, n_reference, n_current).

    The distance is exact: a cell is looked into unless its ends prove that no
    larger gap lies inside. Null values are left out; a feature without values
    on one side has no row.
    """
    mine, theirs = _rows(ref, ["feature"], "value", weight), _rows(cur, ["feature", "window"], "value", weight)
    r1 = materialised(_counted(mine, "feature", "_c"), "reference-cells")
    c1 = materialised(_counted(theirs, "feature", "window", "_c"), "window-cells")
    totals = c1.groupBy("feature", "window").agg(F.sum("_n").alias("ct")).join(r1.groupBy("feature").agg(F.sum("_n").alias("rt")), "feature")
    start = totals.withColumns({"r0": F.lit(0).cast("long"), "c0": F.lit(0).cast("long")})
    first = materialised(_gaps(start, r1, c1, [], "_c"), "gaps")
    extremes = r1.select("feature", "_c", "_lo", "_hi").unionByName(c1.select("feature", "_c", "_lo", "_hi")).groupBy("feature", "_c").agg(
        F.min("_lo").alias("_from"), F.max("_hi").alias("_to")
    ).where("_from < _to")
    open1 = _still_open(first, _best(first)).join(extremes, ["feature", "_c"]).select("feature", "window", "_c", "r0", "c0", "rt", "ct", "_from", "_to")
    open1 = materialised(open1, "open-cells")

    def parts(rows: DataFrame, *keys: str) -> DataFrame:
        wanted = open1.select(*keys, "_c", "_from", "_to").distinct()
        return _counted(rows.join(wanted, [*keys, "_c"]).withColumn("_p", part_of(F.col("_v"), F.col("_from"), F.col("_to"))), *keys, "_c", "_p")

    r2, c2 = materialised(parts(mine, "feature"), "reference-parts"), materialised(parts(theirs, "feature", "window"), "window-parts")
    second = materialised(_gaps(open1.drop("_from", "_to"), r2, c2, ["_c"], "_p"), "part-gaps")
    open2 = materialised(
        _still_open(second, _best(first, second)).select("feature", "window", "_c", "_p", "r0", "c0", "rt", "ct")
        .join(open1.select("feature", "window", "_c", "_from", "_to"), ["feature", "window", "_c"]), "open-parts",
    )

    def values(rows: DataFrame, *keys: str) -> DataFrame:
        place = part_of(F.col("_v"), F.col("_from"), F.col("_to"))
        wanted = open2.select(*keys, "_c", "_p", "_from", "_to").distinct().withColumnRenamed("_p", "_want")
        held = rows.join(wanted, [*keys, "_c"]).withColumn("_p", place).where("_p = _want")
        return held.groupBy(*keys, "_c", "_p", "_v").agg(F.sum("_w").alias("_n"))

    third = _gaps(open2.drop("_from", "_to"), values(mine, "feature"), values(theirs, "feature", "window"), ["_c", "_p"], "_v")
    return _best(first, second, third).join(totals, ["feature", "window"]).select(
        "feature", "window", F.col("best").alias("ks_statistic"), F.col("rt").alias("n_reference"), F.col("ct").alias("n_current")
    )
