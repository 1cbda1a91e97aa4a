"""Reverse geocoding: the nearest city of a gazetteer for every point, with the metro rule.

Different coordinates are looked up once each, and cities of one coordinate are one place, by joins on grid cells that Spark plans by size; neither
side is ever shipped whole by this code.

1. Near: each place is put in its cell and those around it, so a point's own cell holds all places of its neighbourhood. The nearest one settles the
   point when no place outside can be nearer or within metro distance. A cell's columns are as wide as its latitude asks, so that this holds up to the
   poles. Points unsettled in fine cells go on to wider ones.
2. Far: only what is left goes on. The places of each coarse cell are in a ball (centre, radius); a grid has at most CELLS cells, whatever the
   gazetteer. The balls bound the distance from both sides, and a coordinate joins just the cells that may hold its nearest city.

A cell's places are arrays of about CHUNK at most, and a point meets an array as one row: pairs of points and places are compared inside the row, never
made into rows. Candidates are compared by the squared chord between unit vectors, which orders like the great-circle distance at a fraction of its
cost; distances in kilometres are computed for the chosen one. Hot cells are left to AQE's skew splitting.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.dates import bind
from ..functions.geo import haversine_km, valid_point
from ..session import cut_and_count, cut_lineage

#: Degrees of a near cell: SPARSE, or first FINE from DENSE_FROM places on. Both divide 180.
SPARSE, FINE, DENSE_FROM = 2.0, 0.5, 100_000

#: Degrees of a coarse cell, and how many of them there are.
COARSE = 6.0
CELLS = 60 * 30

#: Places of a cell that make one row.
CHUNK = 2_000

PLACE_TYPE = "struct<area:string,city:string,region:string,country:string>"
_AT = ["_lat", "_lon"]
_METRO_CHORD = 2 * math.sin(fv.METRO_KM / fv.EARTH_KM / 2)

#: Bits of a near cell's number that are its column.
_COLUMN_BITS = 20


def _row(lat: Column, size: float) -> Column:
    return F.least(F.floor((lat + 90) / size), F.lit(int(180 / size) - 1)).cast("int")


def _columns(row: Column, size: float) -> Column:
    """Near cells of a row: each at least `size` degrees wide, measured along the row's edge that is nearer to a pole."""
    edge = F.greatest(F.abs(row * size - 90), F.abs((row + 1) * size - 90))
    return F.greatest(F.floor(F.cos(F.radians(edge)) * (360 / size)), F.lit(1)).cast("int")


def _cell(row: Column, lon: Column, size: float, step: int = 0) -> Column:
    """Number of the near cell of a row that holds a longitude, or the one `step` columns further."""
    n = _columns(row, size)
    return F.shiftleft(row, _COLUMN_BITS) + F.pmod(F.floor((lon + 180) / 360 * n).cast("int") + step, n)


def _coarse(lat: Column, lon: Column) -> Column:
    return _row(lat, COARSE) * int(360 / COARSE) + F.pmod(F.floor((lon + 180) / COARSE).cast("int"), F.lit(int(360 / COARSE)))


def _reach_km(lat: Column, size: float) -> Column:
    """No place outside the cells around a point's is nearer: one cell of latitude, or the distance to the meridian one column away.

    Rows of three columns or fewer are seen whole.
    """
    n, rad = _columns(_row(lat, size), size), math.radians(size)
    aside = F.when(n > 3, F.asin(F.cos(F.radians(lat)) * F.sin(2 * math.pi / n)))
    return F.least(F.lit(rad), aside) * (fv.EARTH_KM * (1 - 1e-9))


def _unit_vector(lat: Column, lon: Column) -> dict[str, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return {"_x": F.cos(la) * F.cos(lo), "_y": F.cos(la) * F.sin(lo), "_z": F.sin(la)}


def _places(cities: DataFrame) -> DataFrame:
    """(lat, lon, _city, _big): the cities of one coordinate, as the one of the lowest city_id and the largest one."""
    known = cities.filter(valid_point(F.col("lat"), F.col("lon")))
    big = F.struct(F.col("population").alias("p"), (-F.col("city_id")).alias("tie"), F.col("name").alias("name"))
    return known.groupBy("lat", "lon").agg(F.min(F.struct("city_id", "name", "population", "region", "country")).alias("_city"), F.max(big).alias("_big"))


def _arrays(placed: DataFrame) -> DataFrame:
    """(_cell, _held): the places of each cell in arrays of about CHUNK at most."""
    chunks = placed.groupBy("_cell").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    held = F.struct("lat", "lon", "_x", "_y", "_z", F.col("_city.city_id").alias("id"), F.col("_big.p").alias("p"), F.col("_big.tie").alias("tie"))
    dealt = placed.join(chunks, "_cell").select("_cell", F.pmod(F.xxhash64("lat", "lon"), F.col("_chunks")).alias("_chunk"), held.alias("_place"))
    return dealt.groupBy("_cell", "_chunk").agg(F.collect_list("_place").alias("_held")).select("_cell", "_held")


def _nearest(asked: DataFrame, placed: DataFrame) -> DataFrame:
    """(_lat, _lon, _first, _most): of the places in each coordinate's cells (column _cell of both) the nearest one, and that of the largest city within metro distance.

    Equal distances go to the lowest city_id, equal populations too.
    """

    def away(c: Column) -> Column:
        d = [F.col(v) - c[v] for v in ("_x", "_y", "_z")]
        return F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("chord2"), c["id"].alias("id"), c["lat"].alias("lat"), c["lon"].alias("lon"), c["p"].alias("p"), c["tie"].alias("tie"))

    def best(near: Column) -> Column:
        close = F.filter(near, lambda c: c["chord2"] <= _METRO_CHORD**2)
        most = F.array_max(F.transform(close, lambda c: F.struct(c["p"].alias("p"), c["tie"].alias("tie"), c["lat"].alias("lat"), c["lon"].alias("lon"))))
        return F.struct(F.array_min(near).alias("first"), most.alias("most"))

    met = asked.join(_arrays(placed), "_cell").select(*_AT, bind(F.transform("_held", away), best).alias("_b"))
    return met.groupBy(*_AT).agg(F.min("_b.first").alias("_first"), F.max("_b.most").alias("_most"))


def _near(asked: DataFrame, places: DataFrame, size: float) -> DataFrame:
    """`_nearest` of the coordinates that the cells of `size` degrees around them settle."""
    row = F.explode(F.filter(F.array(*(_row(F.col("lat"), size) + i for i in (-1, 0, 1))), lambda r: (r >= 0) & (r < int(180 / size))))
    spread = places.withColumn("_row", row)
    spread = spread.withColumn("_cell", F.explode(F.array_distinct(F.array(*(_cell(F.col("_row"), F.col("lon"), size, j) for j in (-1, 0, 1))))))
    near = _nearest(asked.withColumn("_cell", _cell(_row(F.col("_lat"), size), F.col("_lon"), size)), spread)
    km, reach = 2 * fv.EARTH_KM * F.asin(F.sqrt("_first.chord2") / 2), _reach_km(F.col("_lat"), size)
    return cut_lineage(near.filter((km <= reach) & (reach >= fv.METRO_KM)))


def _balls(places: DataFrame) -> pd.DataFrame:
    """cell, centre and radius (as chords) of the places of each coarse cell; at most CELLS rows."""
    placed = places.select(_coarse(F.col("lat"), F.col("lon")).alias("_cell"), "_x", "_y", "_z")
    centre = placed.groupBy("_cell").agg(*(F.avg(v).alias(f"_m{v}") for v in ("_x", "_y", "_z")))
    d = [F.col(v) - F.col(f"_m{v}") for v in ("_x", "_y", "_z")]
    radius = F.max(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return placed.join(centre, "_cell").groupBy("_cell", "_m_x", "_m_y", "_m_z").agg(radius.alias("radius")).toPandas()


def _far(rest: DataFrame, places: DataFrame) -> DataFrame:
    """`_nearest` of coordinates through the coarse cells that may hold their nearest city or one within metro distance."""
    balls = _balls(places)
    cell, centre, radius = balls["_cell"].to_numpy(np.int64), balls[["_m_x", "_m_y", "_m_z"]].to_numpy(float), balls["radius"].to_numpy(float)

    @F.pandas_udf("array<int>")
    def cells(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        p, out = np.stack([x, y, z], axis=1), []
        if not len(cell):
            return pd.Series([[] for _ in p])
        for at in range(0, len(p), 1_024):
            away = np.sqrt(((p[at : at + 1_024, None, :] - centre) ** 2).sum(axis=2))
            limit = np.maximum((away + radius).min(axis=1), _METRO_CHORD) + 1e-9
            out += [cell[row] for row in away - radius <= limit[:, None]]
        return pd.Series(out)

    placed = places.withColumn("_cell", _coarse(F.col("lat"), F.col("lon")))
    return _nearest(rest.withColumn("_cell", F.explode(cells("_x", "_y", "_z"))), placed)


def reverse_geocode(points: DataFrame, cities: DataFrame) -> DataFrame:
    """Adds place_name, place_area, place_city, place_region, place_country to points with lat and lon.

    `cities`: city_id, name, lat, lon, population, region, country, of any number. Equal distances go to the lowest city_id.
    Country at any distance, region within 160 km, city within 40 km. A much larger city within 25 km becomes the
    city and the nearest one its area. Points without valid coordinates, and all points of an empty gazetteer, have no place.
    """
    places, n = cut_and_count(_places(cities).withColumns(_unit_vector(F.col("lat"), F.col("lon"))), F.lit(True))
    valid = valid_point(F.col("lat"), F.col("lon"))
    asked = points.filter(valid).select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct()
    rest = asked = cut_lineage(asked.withColumns(_unit_vector(F.col("_lat"), F.col("_lon"))))
    found = []
    for size in (FINE, SPARSE) if n >= DENSE_FROM else (SPARSE,):
        found.append(_near(rest, places, size))
        rest = rest.join(found[-1].select(*_AT), _AT, "left_anti")
    found.append(_far(rest, places))
    chosen = _named(reduce(DataFrame.union, found), places)
    df = points.join(chosen, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left")
    parts = F.array_compact(F.array("_best.area", "_best.city", "_best.region", "_best.country"))
    name = F.nullif(F.array_join(F.array_distinct(parts), ", "), F.lit(""))
    return df.select(
        *[points[c] for c in points.columns if not c.startswith("place_")],
        name.alias("place_name"),
        *[F.col(f"_best.{p}").alias(f"place_{p}") for p in ("area", "city", "region", "country")],
    )


def _named(chosen: DataFrame, places: DataFrame) -> DataFrame:
    """(_lat, _lon, _best): the names of the chosen places."""
    at = [F.col(c).alias(f"_p{c}") for c in ("lat", "lon")]
    first = chosen.select(*_AT, F.col("_first.lat").alias("_plat"), F.col("_first.lon").alias("_plon"), "_most").join(places.select(*at, "_city"), ["_plat", "_plon"])
    city = F.struct(*(F.col(f"_city.{c}").alias(c) for c in ("city_id", "name", "population", "region", "country")), F.col("_plat").alias("lat"), F.col("_plon").alias("lon"))
    # the place of the largest city is looked up only if that isn't the nearest one
    larger = F.when(F.col("_most.tie") != -F.col("_city.city_id"), F.col("_most"))
    both = first.select(*_AT, city.alias("_first"), larger["lat"].alias("_plat"), larger["lon"].alias("_plon"))
    both = both.join(places.select(*at, "_big"), ["_plat", "_plon"], "left")
    return both.select(*_AT, _choose(F.col("_first"), F.col("_big")).alias("_best"))


def _choose(first: Column, big: Column) -> Column:
    """Place names of the nearest city `first`, given the largest within metro distance (null if there is none)."""

    def names(near: Column) -> Column:
        km = near["km"]
        is_city = km <= fv.CITY_KM
        metro = (
            (-big["tie"] != first["city_id"])
            & (big["p"] >= fv.METRO_POPULATION)
            & (big["p"] >= fv.METRO_RATIO * F.greatest(first["population"], F.lit(1)))
        )
        metro = F.coalesce(is_city & metro, F.lit(False))
        return F.struct(
            F.when(metro, first["name"]).alias("area"),
            F.when(metro, big["name"]).when(is_city, first["name"]).alias("city"),
            F.when(km <= fv.REGION_KM, first["region"]).alias("region"),
            first["country"].alias("country"),
        )

    km = haversine_km(F.col("_lat"), F.col("_lon"), first["lat"], first["lon"])
    return F.when(first.isNotNull(), bind(F.struct(km.alias("km")), names))
