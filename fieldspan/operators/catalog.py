"""Site catalogues: filters, inventories, ids and download plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import coerced
from ..session import written

# The columns of the two catalogues and the names used here.
TOWER_NAMES = {
    "site_id": "SITE_ID", "site_name": "SITE_NAME", "igbp": "IGBP", "country": "COUNTRY", "state": "STATE", "latitude": "LOCATION_LAT",
    "longitude": "LOCATION_LONG", "elevation": "LOCATION_ELEV", "data_policy": "DATA_POLICY", "tower_start": "TOWER_BEGAN",
    "tower_end": "TOWER_END", "mat": "MAT", "map": "MAP", "koeppen": "CLIMATE_KOEPPEN",
}
STATION_NAMES = {
    "id": "SITE_ID", "name": "SITE_NAME", "country": "COUNTRY", "theme": "THEME", "siteType": "SITE_TYPE",
    "lat": "LOCATION_LAT", "lon": "LOCATION_LONG", "elevation": "LOCATION_ELEV", "icosclass": "ICOS_CLASS", "uri": "URI",
}
TOWER_NUMBERS = ("LOCATION_LAT", "LOCATION_LONG", "LOCATION_ELEV", "TOWER_BEGAN", "TOWER_END", "DATA_START", "DATA_END", "MAT", "MAP")
STATION_NUMBERS = ("LOCATION_LAT", "LOCATION_LONG", "LOCATION_ELEV")


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The columns of ``names`` that exist get their new names."""
    return df.withColumnsRenamed(dict(names))


def years_of(values: Column) -> Column:
    """The whole numbers among the entries of an array, as int; other entries go."""
    text = F.filter(F.transform(values, lambda y: y.cast("string")), lambda y: y.rlike("^[0-9]+$"))
    return F.filter(F.transform(text, lambda y: y.try_cast("int")), lambda y: y.isNotNull())


def with_year_range(df: DataFrame, source: str, start: str, end: str, replace: bool = False) -> DataFrame:
    """``start`` and ``end`` from the years in an array column, where it exists and, unless
    ``replace``, where ``start`` does not."""
    if source not in df.columns or (start in df.columns and not replace):
        return df
    return df.withColumns({start: F.array_min(years_of(F.col(source))), end: F.array_max(years_of(F.col(source)))})


def tower_catalog(raw: DataFrame, flux_col: str | None = None, flux_start: str = "FLUX_START", flux_end: str = "FLUX_END") -> DataFrame:
    """A raw tower catalogue with its names, year ranges and numbers."""
    df = with_year_range(renamed(raw, TOWER_NAMES), "base_data", "DATA_START", "DATA_END")
    if flux_col:
        df = with_year_range(df, flux_col, flux_start, flux_end, replace=True)
    return coerced(df, (*TOWER_NUMBERS, flux_start, flux_end))


def station_catalog(raw: DataFrame) -> DataFrame:
    return coerced(renamed(raw, STATION_NAMES), STATION_NUMBERS)


def _all(df: DataFrame, tests: Sequence[Column | None]) -> DataFrame:
    for t in tests:
        df = df if t is None else df.filter(t)
    return df


def _isin(col: str, values) -> Column | None:
    return F.col(col).isin(list(values)) if values else None


def _between(col: str, ends) -> Column | None:
    return F.col(col).between(*ends) if ends else None


# The argument names of this filter and the next, which are their interface.
def filter_towers(sites: DataFrame, igbp=None, country=None, lat_range=None, lon_range=None, data_policy=None, min_years=None, flux_only=True, flux_col: str = "flux_data", flux_start: str = "FLUX_START", flux_year_range=None, min_flux_years=None, active_only=False) -> DataFrame:
    """All given predicates at once; one left out, or an empty list, tests nothing.

    ``min_years`` compares end minus start. Years of ``flux_col`` in the window count
    as often as they are listed; the window alone asks for one. Predicates on the flux
    columns are skipped where these are missing.
    """
    tests = [_isin("IGBP", igbp), _isin("COUNTRY", country), _between("LOCATION_LAT", lat_range), _between("LOCATION_LONG", lon_range), _isin("DATA_POLICY", data_policy)]
    if min_years is not None:
        tests.append(F.col("DATA_END") - F.col("DATA_START") >= min_years)
    if flux_only and flux_start in sites.columns:
        tests.append(F.col(flux_start).isNotNull())
    if flux_col in sites.columns and (flux_year_range is not None or min_flux_years is not None):
        lo, hi = flux_year_range or (0, 9999)
        count = F.coalesce(F.size(F.filter(years_of(F.col(flux_col)), lambda y: y.between(lo, hi))), F.lit(0))
        tests.append(count > 0 if flux_year_range is not None else None)
        tests.append(count >= min_flux_years if min_flux_years is not None else None)
    if active_only:
        tests.append(F.col("TOWER_END").isNull())
    return _all(sites, tests)


def filter_stations(sites: DataFrame, theme: str | None = "ES", country=None, site_type=None, lat_range=None, lon_range=None, site_class=None, class_col: str = "ICOS_CLASS") -> DataFrame:
    """As ``filter_towers``; theme, type and class are skipped where missing."""
    have = sites.columns
    return _all(sites, [
        F.col("THEME") == theme if theme and "THEME" in have else None,
        _isin("COUNTRY", country),
        _isin("SITE_TYPE", site_type) if "SITE_TYPE" in have else None,
        _between("LOCATION_LAT", lat_range),
        _between("LOCATION_LONG", lon_range),
        _isin(class_col, site_class) if class_col in have else None,
    ])


def id_of_uri(uri: Column) -> Column:
    """Last part of the path without its prefix up to the first ``_``; '' for none."""
    return F.coalesce(F.regexp_replace(F.element_at(F.split(uri, "/"), -1), "^[^_]*_", ""), F.lit(""))


def id_of_file(name: Column) -> Column:
    """What stands before the first ``_``."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def swapped_host(uri: Column, old: str, new: str) -> Column:
    """The same address on another host."""
    return F.replace(uri, F.lit(old), F.lit(new))


def overlapping(objects: DataFrame, first: int, last: int) -> DataFrame:
    """Objects that overlap 1 January of ``first`` to 31 December of ``last``, 00:00."""
    return objects.filter((F.col("time_end") >= F.lit(f"{first}-01-01").cast("timestamp")) & (F.col("time_start") <= F.lit(f"{last}-12-31").cast("timestamp")))


def inventory(objects: DataFrame, sites: DataFrame | None = None, year_range: tuple[int, int] | None = None, min_years: int | None = None) -> DataFrame:
    """(SITE_ID, N_YEARS, YEARS, DATA_OBJECTS) of sites that have objects.

    ``objects``: station_uri, uri, time_start, time_end, ord (catalogue order). The site
    of an object is the id in its ``station_uri``; ``sites`` (SITE_ID) restricts and may
    repeat an id, each time with a row of its own; further columns of it, such as the
    place in a request list, stay. Years are distinct and inside the window. A site's
    row lists all its objects, so its length grows with them.
    """
    lo, hi = year_range or (0, 9999)
    objs = objects.withColumn("SITE_ID", id_of_uri(F.col("station_uri")))
    if year_range is not None:
        objs = overlapping(objs, lo, hi)
    a, z = F.greatest(F.year("time_start"), F.lit(lo)), F.least(F.year("time_end"), F.lit(hi))
    # a reversed range has no years, where sequence() would count down
    years = F.when(a <= z, F.sequence(a, z)).otherwise(F.array().cast("array<int>"))
    per = objs.withColumn("y", years).groupBy("SITE_ID").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("y")))).alias("YEARS"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "uri"))), lambda s: s["uri"]).alias("DATA_OBJECTS"),
    )
    per = per.select("SITE_ID", F.size("YEARS").cast("long").alias("N_YEARS"), "YEARS", "DATA_OBJECTS")
    if min_years is not None:
        per = per.filter(F.col("N_YEARS") >= min_years)
    return per if sites is None else sites.join(per, "SITE_ID")


def missing_ids(requested: DataFrame, received: DataFrame, key: str = "SITE_ID") -> DataFrame:
    """Requested ids that did not come; repeats stay."""
    return requested.join(received.select(key).distinct(), key, "left_anti")


def batches(ids: DataFrame, order: Sequence[str], size: int = 10) -> DataFrame:
    """``ids`` plus ``batch``: 0 for the first ``size`` in order, 1 for the next, and so on.

    Rows are put in ranges of the order, and numbered within a range while they are
    written; the counts of the ranges ahead, one row for each, give the position. The
    ranges are written before they are counted: two plans over one range exchange may
    draw different bounds. Rows alike in ``order`` come in any order.
    """
    at, cols = "batch_at_", [F.col(c) for c in order]
    ranged = ids.drop("batch").repartitionByRange(*cols).sortWithinPartitions(*cols)
    held = written(ranged.withColumn(at, F.monotonically_increasing_id()))
    part, row = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    count = held.groupBy(part.alias("batch_part_")).agg(F.count(F.lit(1)).alias("n_"))
    ahead = F.coalesce(F.sum("n_").over(W.orderBy("batch_part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row per range, of which there are at most as many as shuffle partitions
    ahead = count.select("batch_part_", ahead.alias("batch_ahead_"))
    out = held.join(F.broadcast(ahead), part == F.col("batch_part_"))
    return out.withColumn("batch", F.floor((F.col("batch_ahead_") + row) / size).cast("long")).drop(at, "batch_part_", "batch_ahead_")


def download_plan(ids: DataFrame, existing: DataFrame | None = None, key: str = "SITE_ID", size: int = 10) -> DataFrame:
    """What is still to fetch, in batches; ids that ``existing`` lists are skipped."""
    todo = ids if existing is None else missing_ids(ids, existing, key)
    return batches(todo, [key], size)


def newest(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """The path of latest modification for each key."""
    return files.groupBy(*by).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def seeded_sample(df: DataFrame, key: str, k: int = 100, seed: int = 42) -> DataFrame:
    """``k`` rows, the same ones for the same seed, whatever their order."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)
