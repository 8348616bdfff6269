"""Route geometry (J10, J11, N2-N4) as row-local expressions and equi-joins.

No nested-loop joins: the fuzzy city match goes through an index of
three-character grams and then verifies, and the sea-lane choice is an ordered
CASE chain over the fixed rule list, evaluated inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import expressions as X

POINT = "struct<lat:double,lon:double>"


def _pt(lat, lon) -> Column:
    return F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))


# J10 ----------------------------------------------------------------------
GRAM = 3


def _grams(s: Column, size: int) -> Column:
    """Distinct grams of one size, as many as the text has places at most; none where the text is shorter."""
    places = F.when(F.length(s) >= size, F.sequence(F.lit(1), F.length(s) - size + 1))
    return F.array_distinct(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.substring(s, i, size)))


def containing(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs (outer, inner) in which the text of column ``inner`` stands within that of ``outer``.

    An inverted index with verification: an outer text is listed under its
    grams of up to three characters; an inner text is looked up under that one
    of its own three-character grams (a shorter text: under itself) which the
    fewest outer texts hold, and what is found is then compared. Lists carry a
    hash of the outer text; texts with equal hashes are told apart by the
    comparison. Null and empty texts pair with nothing; repeated ones count once.
    """
    o = outer.select("outer").where("outer <> ''").distinct().withColumn("_id", F.xxhash64("outer"))
    i = inner.select("inner").where("inner <> ''").distinct()
    listed = o.select("_id", F.explode(F.concat(*[_grams(F.col("outer"), n) for n in range(1, GRAM + 1)])).alias("_gram"))
    own = F.when(F.length("inner") < GRAM, F.array("inner")).otherwise(_grams(F.col("inner"), GRAM))
    wanted = i.select("inner", F.explode(own).alias("_gram"))
    sizes = listed.join(wanted.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # a gram that no outer text holds rules the inner text out; the smallest list says so
    rarest = wanted.join(sizes, "_gram", "left").groupBy("inner").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_best"))
    looked = rarest.where("_best.n > 0").select("inner", F.col("_best._gram").alias("_gram"))
    found = listed.join(looked, "_gram").select("_id", "inner").join(o, "_id")
    return found.where(F.contains("outer", "inner")).select("outer", "inner")


def city_coordinates(cities: DataFrame, dictionary: DataFrame, city: str = "city") -> DataFrame:
    """City -> (lat, lon): exact on lower(trim(name)), else the first dictionary
    entry (lowest ordinal) whose name contains the key or is contained in it.

    ``dictionary``: name (lower case), ordinal, lat, lon. Works per distinct
    key, then joins back, so repeated cities cost one lookup. An empty key is
    contained in every name, and an empty name in every key; a null city and a
    city that fits no entry get nulls. Of entries with equal names the first counts.
    """
    keys = cities.select(F.lower(F.trim(F.col(city))).alias("key")).where("key is not null").distinct()
    d = dictionary.where("name is not null").groupBy("name").agg(F.min(F.struct("ordinal", "lat", "lon")).alias("entry"))
    looked = keys.join(d.select(F.col("name").alias("key"), F.col("entry").alias("exact")), "key", "left")
    misses = looked.where("exact is null").select("key")
    as_outer = containing(misses.select(F.col("key").alias("outer")), d.select(F.col("name").alias("inner")))
    as_inner = containing(d.select(F.col("name").alias("outer")), misses.select(F.col("key").alias("inner")))
    pairs = as_outer.select(F.col("outer").alias("key"), F.col("inner").alias("name")).unionByName(
        as_inner.select(F.col("inner").alias("key"), F.col("outer").alias("name")))
    found = pairs.join(d, "name").select("key", "entry")
    first = d.agg(F.min("entry").alias("entry"))  # one row
    found = found.unionByName(misses.where("key = ''").crossJoin(first))
    found = found.unionByName(misses.crossJoin(d.where("name = ''").select("entry")))  # at most one row on the right
    fuzzy = found.groupBy("key").agg(F.min("entry").alias("fuzzy"))
    best = looked.join(fuzzy, "key", "left").select(F.col("key").alias("_key"), F.coalesce("exact", "fuzzy").alias("_hit"))
    out = cities.join(best, F.lower(F.trim(F.col(city))) == F.col("_key"), "left")
    return out.select(*cities.columns, F.col("_hit.lat").alias("lat"), F.col("_hit.lon").alias("lon"),
                      F.col("_hit.ordinal").alias("dictionary_ordinal"))


# J11 ----------------------------------------------------------------------
def _waypoint_array(names) -> Column:
    pts = [(_pt(*C.WAYPOINTS[n]) if isinstance(n, str) else _pt(*n)) for n in names]
    return F.array(*pts).cast(f"array<{POINT}>")


def _side(cond, s_lat, s_lon, e_lat, e_lon) -> Column:
    if cond is None:
        return F.lit(True)
    point, axis, op, value = cond
    v = {("s", "lat"): s_lat, ("s", "lon"): s_lon, ("e", "lat"): e_lat, ("e", "lon"): e_lon}[(point, axis)]
    return v > value if op == "gt" else v < value


def lane_waypoints(s_lat, s_lon, e_lat, e_lon, s_reg=None, e_reg=None) -> Column:
    """Ordered sea-lane waypoints between two points (first matching rule), else [].

    Pass precomputed region columns (``s_reg``/``e_reg``) when calling on a
    DataFrame: each rule tests the regions, and re-deriving them per rule
    makes the generated code too large for whole-stage codegen.
    """
    s_lat, s_lon, e_lat, e_lon = (X._c(c) for c in (s_lat, s_lon, e_lat, e_lon))
    s_reg = X._c(s_reg) if s_reg is not None else X.geo_region(s_lat, s_lon)
    e_reg = X._c(e_reg) if e_reg is not None else X.geo_region(e_lat, e_lon)
    # The rule chain yields only the rule number; the waypoint arrays live in
    # one constant table indexed by it (keeps the generated code small).
    rule = None
    for i, (s_regions, e_regions, cond, _names) in enumerate(C.LANE_RULES, start=1):
        hit = s_reg.isin(*s_regions) & e_reg.isin(*e_regions) & _side(cond, s_lat, s_lon, e_lat, e_lon)
        rule = F.when(hit, F.lit(i - 1)) if rule is None else rule.when(hit, F.lit(i - 1))
    table = F.array(*[_waypoint_array(r[3]) for r in C.LANE_RULES])
    empty = F.array().cast(f"array<{POINT}>")
    return F.coalesce(F.get(table, rule), empty)  # no rule -> null index -> []


# N2 -----------------------------------------------------------------------
def polyline_points(pts: Column, steps: int) -> Column:
    """Every leg of the point array sampled at steps + 1 points (joints repeated)."""
    legs = F.sequence(F.lit(0), F.size(pts) - 2)

    def leg(i):
        a, b = F.element_at(pts, i + 1), F.element_at(pts, i + 2)
        return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda s: F.struct(
            (a["lat"] + (b["lat"] - a["lat"]) * (s / F.lit(float(steps)))).alias("lat"),
            (a["lon"] + (b["lon"] - a["lon"]) * (s / F.lit(float(steps)))).alias("lon")))
    return F.flatten(F.transform(legs, leg))


def polyline_linear(start: Column, waypoints: Column, end: Column, steps: int) -> Column:
    """start + waypoints + end, every leg sampled at steps + 1 points (joints repeated)."""
    return polyline_points(F.concat(F.array(start), waypoints, F.array(end)), steps)


# N3 -----------------------------------------------------------------------
def polyline_great_circle(s_lat, s_lon, e_lat, e_lon, n: int = C.GREAT_CIRCLE_POINTS, angle=None) -> Column:
    """n + 1 points on the great circle; identical ends give the start point n + 1 times.

    ``angle``: a precomputed central-angle column (keeps generated code small).
    """
    la1, lo1, la2, lo2 = (F.radians(X._c(c)) for c in (s_lat, s_lon, e_lat, e_lon))
    d = X._c(angle) if angle is not None else X.central_angle(s_lat, s_lon, e_lat, e_lon)

    def point(i):
        f = i / F.lit(float(n))
        a = F.sin((F.lit(1.0) - f) * d) / F.sin(d)
        b = F.sin(f * d) / F.sin(d)
        x = a * F.cos(la1) * F.cos(lo1) + b * F.cos(la2) * F.cos(lo2)
        y = a * F.cos(la1) * F.sin(lo1) + b * F.cos(la2) * F.sin(lo2)
        z = a * F.sin(la1) + b * F.sin(la2)
        moved = F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"),
                         F.degrees(F.atan2(y, x)).alias("lon"))
        still = F.struct(X._c(s_lat).cast("double").alias("lat"), X._c(s_lon).cast("double").alias("lon"))
        return F.when(d == 0, still).otherwise(moved)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), point)


# N4 -----------------------------------------------------------------------
def with_lane_waypoints(df: DataFrame, out: str = "waypoints") -> DataFrame:
    """Regions of both ends, then the waypoints, as separate projections."""
    r = df.withColumns({"_s_reg": X.geo_region("o_lat", "o_lon"), "_e_reg": X.geo_region("d_lat", "d_lon")})
    w = r.withColumn(out, lane_waypoints("o_lat", "o_lon", "d_lat", "d_lon", "_s_reg", "_e_reg"))
    return w.drop("_s_reg", "_e_reg")


def route_geometry(df: DataFrame, carrier: str = "carrier_type") -> DataFrame:
    """Route polyline and its type per row, from carrier and countries.

    Road service results are not available here, so road and same-country
    routes take the fallback branch: same country and not Ocean -> straight
    legs (12 steps), 'air' for Air else 'road'; other road -> sea lanes
    (8 steps) labelled 'ocean'; Ocean -> sea lanes; Air across borders ->
    great circle; same-country Ocean -> no route.

    The geometry depends only on the two points and the branch, so it is
    built once per distinct (points, branch) and joined back: rows that
    differ only in countries or carrier share one polyline computation.
    """
    c = F.col(carrier)
    is_road = c.isin("FTL", "LTL", "Intermodal")
    is_ocean, is_air = c == "Ocean", c == "Air"
    same = F.upper("origin_country") == F.upper("destination_country")
    road_branch = is_road | same
    branch = (F.when(road_branch & same & ~is_ocean, "direct")
               .when(road_branch & ~is_ocean, "sea")
               .when(road_branch, "none")
               .when(is_ocean, "sea")
               .when(is_air, "arc")
               .otherwise("none"))
    rtype = (F.when(road_branch & same & ~is_ocean, F.when(is_air, "air").otherwise("road"))
              .when(road_branch & ~is_ocean, "ocean")
              .when(road_branch, "")
              .when(is_ocean, "ocean")
              .when(is_air, "air")
              .otherwise(""))
    keys = ["o_lat", "o_lon", "d_lat", "d_lon", "_branch"]
    tagged = df.withColumns({"_branch": branch, "route_type": rtype})
    shapes = polylines_for(tagged.select(*keys).distinct())
    cond = [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]
    j = tagged.join(shapes.select(*[F.col(k).alias(f"_s{k}") for k in keys], "route"), cond, "left")
    return j.select(*df.columns, "route", "route_type")


def polylines_for(shapes: DataFrame) -> DataFrame:
    """``route`` for distinct (o_lat, o_lon, d_lat, d_lon, _branch) rows."""
    start = F.struct(F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon"))
    end = F.struct(F.col("d_lat").alias("lat"), F.col("d_lon").alias("lon"))
    empty = F.array().cast(f"array<{POINT}>")
    # one projection per building block, so no expression is repeated inside another
    x = with_lane_waypoints(shapes, "_waypoints").withColumns({
        "_sea_pts": F.concat(F.array(start), F.col("_waypoints"), F.array(end)),
        "_direct_pts": F.array(start, end),
        "_angle": X.central_angle("o_lat", "o_lon", "d_lat", "d_lon")})
    b = F.col("_branch")
    route = (F.when(b == "direct", polyline_points(F.col("_direct_pts"), C.DOMESTIC_LEG_STEPS))
              .when(b == "sea", polyline_points(F.col("_sea_pts"), C.OCEAN_LEG_STEPS))
              .when(b == "arc", polyline_great_circle("o_lat", "o_lon", "d_lat", "d_lon", angle="_angle"))
              .otherwise(empty))
    return x.withColumn("route", route).drop("_waypoints", "_sea_pts", "_direct_pts", "_angle")
