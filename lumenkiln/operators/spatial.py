"""Nearest neighbours within a radius by grid cells, and what spreads along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def _with_cells(points: DataFrame, lat: str, lon: str, radius_m: float, spread: bool) -> DataFrame:
    """Rows with their grid cell (row, col); with spread, one for every cell that may hold a neighbour."""
    row = geo.cell_rows(F.col(lat), radius_m)
    if not spread:
        points = points.withColumn("_row", row)
        return points.withColumn("_col", geo.cell_columns(F.col("_row"), F.col(lon), radius_m)[0])
    points = points.withColumn("_row", F.explode(F.array(row - 1, row, row + 1)))
    col, count = geo.cell_columns(F.col("_row"), F.col(lon), radius_m)
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("_c") + d, F.col("_n"))))
    return points.withColumns({"_c": col, "_n": count}).withColumn("_col", F.explode(around)).drop("_c", "_n")


def within_radius(probe: DataFrame, target: DataFrame, radius_m: float, *, on: list[str], earth_m: float = geo.EARTH_M) -> DataFrame:
    """Pairs of probe (p_lat, p_lon) and target (t_lat, t_lon) rows at most radius_m apart with equal ``on`` columns.

    An equi-join on grid cells, exact by haversine; rows without coordinates pair with nothing.  The columns of both
    sides other than ``on`` have to differ.
    """
    p = _with_cells(probe.filter("p_lat is not null and p_lon is not null"), "p_lat", "p_lon", radius_m, True)
    t = _with_cells(target.filter("t_lat is not null and t_lon is not null"), "t_lat", "t_lon", radius_m, False)
    pairs = p.join(t, [*on, "_row", "_col"]).drop("_row", "_col")
    pairs = pairs.withColumn("distance_m", geo.haversine(F.col("p_lat"), F.col("p_lon"), F.col("t_lat"), F.col("t_lon"), earth_m))
    return pairs.filter(F.col("distance_m") <= radius_m)


def in_box(radius_m: float) -> Column:
    """The rectangle around the probe, across the antimeridian and at the poles."""
    wide = geo.lon_delta(F.col("p_lat"), radius_m)
    return (F.abs(F.col("p_lat") - F.col("t_lat")) <= geo.lat_delta(radius_m)) & ((wide >= 180) | (geo.lon_apart(F.col("p_lon"), F.col("t_lon")) <= wide))


def nearest_resolved(probe: DataFrame, target: DataFrame, radius_m: float, *, key: str, candidate_cap: int | None = None, on: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """The nearest resolved target (t_id, t_updated) of each probe row; ties go to the latest update, then the greatest id.

    Many rows share one spot, so spots are paired and not rows: each distinct probe place meets each distinct target place, which
    stands for its best targets.  candidate_cap reproduces a reader that looks only at the latest so many targets of the box, which changes answers
    only in dense places; without it the answer is exact.
    """
    newest = F.struct(F.coalesce(F.unix_micros(F.col("t_updated").cast("timestamp")), F.lit(-(1 << 62))).alias("u"), F.col("t_id").alias("t_id"))
    spot_p, spot_t = [*on, "p_lat", "p_lon"], [*on, "t_lat", "t_lon"]
    spots = probe.select(*spot_p).distinct()
    if candidate_cap is None:
        best_here = target.groupBy(*spot_t).agg(F.max(newest).alias("t"))
        pairs = within_radius(spots, best_here, radius_m, on=list(on))
        best = F.min_by(F.struct("t.t_id", "distance_m"), F.struct("distance_m", (-F.col("t.u")).alias("u"), (-F.col("t.t_id")).alias("i")))
    else:
        # of one spot no more than the cap can be among the latest of a box; the box reaches beyond the circle, so cells are taken half as wide again
        kept = target.withColumn("_n", F.row_number().over(Window.partitionBy(*spot_t).orderBy(F.col("t_updated").desc_nulls_last(), F.col("t_id").desc()))).filter(F.col("_n") <= candidate_cap)
        here = kept.groupBy(*spot_t).agg(F.collect_list(newest).alias("ts"))
        p = _with_cells(spots.filter("p_lat is not null and p_lon is not null"), "p_lat", "p_lon", 1.5 * radius_m, True)
        t = _with_cells(here.filter("t_lat is not null and t_lon is not null"), "t_lat", "t_lon", 1.5 * radius_m, False)
        pairs = p.join(t, [*on, "_row", "_col"]).filter(in_box(radius_m)).withColumn("t", F.explode("ts"))
        pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*spot_p).orderBy(F.col("t").desc()))).filter(F.col("_n") <= candidate_cap)
        pairs = pairs.withColumn("distance_m", geo.haversine(F.col("p_lat"), F.col("p_lon"), F.col("t_lat"), F.col("t_lon"))).filter(F.col("distance_m") <= radius_m)
        best = F.min_by(F.struct("t.t_id", "distance_m"), F.struct("distance_m", "_n"))
    of_spot = pairs.groupBy(*spot_p).agg(best.alias("best"))
    return probe.join(of_spot, spot_p).select(key, "best.*")


def todo_and_seeds(rows: DataFrame, *, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows that may get a category, rows that have one); manual categories are never replaced, others only with force."""
    has = F.coalesce(F.trim("category"), F.lit("")) != ""
    todo = rows.filter(F.coalesce(F.col("category_source") != "Manual", F.lit(True)) & (F.lit(force) | ~has) | ~has)
    return todo, rows.filter(has)


def _manual() -> Column:
    return F.when(F.col("category_source") == "Manual", 0).otherwise(1)


def category_by_address(todo: DataFrame, seeds: DataFrame) -> DataFrame:
    """(location_id, address_category): of the rows at the same address but itself the first, manual ones before others, then the latest.

    The two best seeds of an address are enough, as a row must only not take its own; they come of two aggregates, which combine before they move.
    """
    seeds = seeds.filter("street_address is not null")
    rank = F.struct((-_manual()).alias("m"), F.col("modified_at").alias("at"), F.col("location_id").alias("s_id"))
    best = seeds.groupBy("street_address").agg(F.max_by(F.struct(F.col("location_id").alias("s_id"), F.col("category").alias("s_category")), rank).alias("one"))
    rest = seeds.join(best.select(F.col("one.s_id").alias("location_id")), "location_id", "left_anti")
    then = rest.groupBy("street_address").agg(F.max_by("category", rank).alias("two"))
    found = todo.select("location_id", "street_address").join(best, "street_address").join(then, "street_address", "left")
    found = found.select("location_id", F.when(F.col("one.s_id") != F.col("location_id"), F.col("one.s_category")).otherwise(F.col("two")).alias("address_category"))
    return found.filter("address_category is not null")


def category_by_radius(todo: DataFrame, seeds: DataFrame, radius_m: float) -> DataFrame:
    """(location_id, radius_category) of the nearest other categorised row, manual on ties, then the greatest id.  Spots are paired, with two seeds each."""
    spot = ["p_lat", "p_lon"]
    p = todo.select("location_id", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    rank = F.struct((-_manual()).alias("m"), F.col("location_id").alias("i"))
    t = seeds.filter("latitude is not null and longitude is not null").select(F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"), rank.alias("rank"), F.col("category").alias("t_category"))
    one = t.groupBy("t_lat", "t_lon").agg(F.max(F.struct("rank", "t_category")).alias("one"))
    rest = t.join(one.select(F.col("one.rank").alias("rank")), "rank", "left_anti")
    here = one.join(rest.groupBy("t_lat", "t_lon").agg(F.max(F.struct("rank", "t_category")).alias("two")), ["t_lat", "t_lon"], "left")
    near = within_radius(p.select(*spot).distinct(), here.select("t_lat", "t_lon", F.array_compact(F.array("one", "two")).alias("best")), radius_m, on=[], earth_m=geo.LEGACY_EARTH_M)
    # the two best of all seeds around a spot: a row on it must only not take its own
    by = F.struct((-F.col("distance_m")).alias("d"), F.col("s.rank").alias("rank"), F.col("s.t_category").alias("t_category"))
    ranked = near.select(*spot, "distance_m", F.explode("best").alias("s")).select(*spot, by.alias("c"))
    first = ranked.groupBy(*spot).agg(F.max("c").alias("one"))
    second = ranked.join(first, spot).filter("c.rank.i <> one.rank.i").groupBy(*spot).agg(F.max("c").alias("two"))
    found = p.join(first, spot).join(second, spot, "left")
    found = found.select("location_id", F.when(F.col("one.rank.i") != F.col("location_id"), F.col("one.t_category")).otherwise(F.col("two.t_category")).alias("radius_category"))
    return found.filter("radius_category is not null")


def propagated_category(rows: DataFrame, *, radius_m: float = 10.0, force: bool = False) -> DataFrame:
    """Category of each row from one at the same address, else from the nearest categorised one within the radius.

    Rows: location_id, street_address, latitude, longitude, category, category_source, modified_at.
    """
    todo, seeds = todo_and_seeds(rows, force=force)
    out = todo.select("location_id").join(category_by_address(todo, seeds), "location_id", "left").join(category_by_radius(todo, seeds, radius_m), "location_id", "left")
    return out.select(
        "location_id", F.coalesce("address_category", "radius_category").alias("new_category"),
        F.when(F.col("address_category").isNotNull(), "AddressPropagation").when(F.col("radius_category").isNotNull(), "RadiusPropagation10m").alias("new_source"),
    ).filter("new_category is not null")
