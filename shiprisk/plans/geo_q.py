"""Registered geometry and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import expressions as X
from ..functions import text as TX
from ..models.assemble import CONTEXT_COLUMNS, score_assemble
from ..operators import enrich as E
from ..operators import geo as G
from ..sources import testdata as td
from .catalog import register
from .enrichment import _ENRICH_FIX, _ENRICH_SQL, _dims
from .ml_q import assemble_select


def _pairs(spark, sf):
    """Distinct (origin, destination) city pairs with both points' coordinates."""
    sh = td.shipments(spark, sf).select("origin_city", "destination_city").distinct()
    cc = td.city_coordinates(spark, sf)
    o = cc.select(F.col("city").alias("origin_city"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    d = cc.select(F.col("city").alias("destination_city"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    return sh.join(o, "origin_city").join(d, "destination_city")


_PAIRS_SQL = """
SELECT p.origin_city, p.destination_city, o.lat AS o_lat, o.lon AS o_lon, d.lat AS d_lat, d.lon AS d_lon
FROM (SELECT DISTINCT origin_city, destination_city FROM shipments) p
JOIN city_coordinates o ON o.city = p.origin_city
JOIN city_coordinates d ON d.city = p.destination_city"""


def _sql_bounds(lat: str, lon: str, bounds) -> str:
    ops = {"ge": ">=", "gt": ">", "lt": "<"}
    return " AND ".join(f"{lat if a == 'lat' else lon} {ops[op]} {float(v)}" for a, op, v in bounds)


def sql_region(lat: str, lon: str) -> str:
    whens = " ".join(f"WHEN {_sql_bounds(lat, lon, b)} THEN '{r}'" for r, b in C.REGION_RULES)
    return f"(CASE {whens} ELSE '{C.REGION_OTHER}' END)"


def _sql_points(names) -> str:
    pts = [(C.WAYPOINTS[n] if isinstance(n, str) else n) for n in names]
    return "[" + ", ".join(f"{{'lat': CAST({a} AS DOUBLE), 'lon': CAST({b} AS DOUBLE)}}" for a, b in pts) + "]"


def sql_lane_waypoints(s_lat, s_lon, e_lat, e_lon) -> str:
    sr, er = sql_region(s_lat, s_lon), sql_region(e_lat, e_lon)
    whens = []
    for s_regions, e_regions, cond, names in C.LANE_RULES:
        c = f"{sr} IN ({', '.join(repr(r) for r in s_regions)}) AND {er} IN ({', '.join(repr(r) for r in e_regions)})"
        if cond:
            point, axis, op, value = cond
            col = {("s", "lat"): s_lat, ("s", "lon"): s_lon, ("e", "lat"): e_lat, ("e", "lon"): e_lon}[(point, axis)]
            c += f" AND {col} {'>' if op == 'gt' else '<'} {value}"
        whens.append(f"WHEN {c} THEN {_sql_points(names)}")
    return f"(CASE {' '.join(whens)} ELSE []::STRUCT(lat DOUBLE, lon DOUBLE)[] END)"


@register("geodesic_angle", ["city_coordinates", "shipments"], f"""
SELECT origin_city, destination_city,
       round(2 * asin(sqrt(pow(sin((radians(d_lat) - radians(o_lat)) / 2), 2)
             + cos(radians(o_lat)) * cos(radians(d_lat)) * pow(sin((radians(d_lon) - radians(o_lon)) / 2), 2)))
             * 6371.0088, 6) AS distance_km
FROM ({_PAIRS_SQL}) p""")
def q_geodesic_angle(spark, sf):
    """Great-circle distance per city pair (rounded to 6 places for a total comparison)."""
    p = _pairs(spark, sf)
    return p.select("origin_city", "destination_city",
                    F.round(X.geodesic_km("o_lat", "o_lon", "d_lat", "d_lon"), 6).alias("distance_km"))


@register("geo_region", ["city_coordinates", "shipments"], f"""
SELECT city, lat, lon, {sql_region("lat", "lon")} AS region FROM city_coordinates""")
def q_geo_region(spark, sf):
    """Broad region of every city (first matching rule)."""
    cc = td.city_coordinates(spark, sf)
    return cc.select("city", "lat", "lon", X.geo_region("lat", "lon").alias("region"))


@register("city_coordinates", ["city_coordinates", "city_dictionary", "shipments"], """
SELECT c.city, COALESCE(e.lat, f.lat) AS lat, COALESCE(e.lon, f.lon) AS lon,
       COALESCE(e.ordinal, f.ordinal) AS dictionary_ordinal
FROM (SELECT city FROM city_coordinates) c
LEFT JOIN city_dictionary e ON e.name = lower(trim(c.city))
LEFT JOIN (SELECT k.city, arg_min(d.lat, d.ordinal) AS lat, arg_min(d.lon, d.ordinal) AS lon,
                  min(d.ordinal) AS ordinal
           FROM (SELECT city FROM city_coordinates) k, city_dictionary d
           WHERE contains(d.name, lower(trim(k.city))) OR contains(lower(trim(k.city)), d.name)
           GROUP BY k.city) f ON f.city = c.city""")
def q_city_coordinates(spark, sf):
    """Exact dictionary hit, else first entry containing / contained in the name."""
    cities = td.city_coordinates(spark, sf).select("city")
    return G.city_coordinates(cities, td.city_dictionary(spark, sf))


@register("city_match_index", None, """
WITH c AS (SELECT 'CITY_' || CAST(c_custkey AS VARCHAR) AS city FROM customer
           UNION ALL SELECT 'Y_' || CAST(c_custkey AS VARCHAR) FROM customer
           UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN '  ' END FROM customer WHERE c_custkey <= 10),
d AS (SELECT 'city_' || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey AS ordinal, s_acctbal AS lat, -s_acctbal AS lon FROM supplier),
f AS (SELECT k.city, min(d.ordinal) AS ordinal FROM (SELECT DISTINCT city FROM c) k, d
      WHERE contains(d.name, lower(trim(k.city))) OR contains(lower(trim(k.city)), d.name) GROUP BY k.city)
SELECT c.city, d.lat, d.lon, coalesce(d.ordinal, -1) AS dictionary_ordinal
FROM c LEFT JOIN d e ON e.name = lower(trim(c.city)) LEFT JOIN f ON f.city = c.city
LEFT JOIN d ON d.ordinal = coalesce(e.ordinal, f.ordinal)""")
def q_city_match_index(spark, sf):
    """J10 with as many dictionary entries as suppliers and as many names as customers: names that hold an entry, names held by
    entries, blank and null names."""
    c, s = td.table(spark, sf, "customer"), td.table(spark, sf, "supplier")
    k = F.col("c_custkey")
    cities = (c.select(F.concat(F.lit("CITY_"), k).alias("city")).unionByName(c.select(F.concat(F.lit("Y_"), k).alias("city")))
              .unionByName(c.where(k <= 10).select(F.when(k % 2 == 0, "  ").alias("city"))))
    dictionary = s.select(F.concat(F.lit("city_"), F.col("s_suppkey")).alias("name"), F.col("s_suppkey").alias("ordinal"),
                          F.col("s_acctbal").alias("lat"), (-F.col("s_acctbal")).alias("lon"))
    return G.city_coordinates(cities, dictionary).fillna(-1, ["dictionary_ordinal"])


@register("lane_waypoints", ["city_coordinates", "shipments"], f"""
SELECT origin_city, destination_city, CAST(i - 1 AS INTEGER) AS idx, w[i].lat AS lat, w[i].lon AS lon,
       CAST(len(w) AS INTEGER) AS n_waypoints
FROM (SELECT *, {sql_lane_waypoints("o_lat", "o_lon", "d_lat", "d_lon")} AS w FROM ({_PAIRS_SQL}) p0) p,
     LATERAL (SELECT unnest(generate_series(1, len(p.w))) AS i) g""")
def q_lane_waypoints(spark, sf):
    """Sea-lane waypoints per city pair, one row per waypoint."""
    p = G.with_lane_waypoints(_pairs(spark, sf), "w")
    # explode_outer + filter: a plain explode makes the optimizer infer size(w) > 0 and
    # push the whole waypoint expression into the join condition a second time
    return p.select("origin_city", "destination_city", F.posexplode_outer("w").alias("idx", "pt"),
                    F.size("w").alias("n_waypoints")).where(F.col("idx").isNotNull()).select(
        "origin_city", "destination_city", "idx", F.col("pt.lat").alias("lat"), F.col("pt.lon").alias("lon"),
        "n_waypoints")


@register("polyline_linear", ["city_coordinates", "shipments"], f"""
SELECT origin_city, destination_city, CAST(leg * 9 + s AS INTEGER) AS idx,
       pts[leg + 1].lat + (pts[leg + 2].lat - pts[leg + 1].lat) * (CAST(s AS DOUBLE) / 8.0) AS lat,
       pts[leg + 1].lon + (pts[leg + 2].lon - pts[leg + 1].lon) * (CAST(s AS DOUBLE) / 8.0) AS lon
FROM (SELECT origin_city, destination_city,
             [{{'lat': o_lat, 'lon': o_lon}}] || {sql_lane_waypoints("o_lat", "o_lon", "d_lat", "d_lon")}
               || [{{'lat': d_lat, 'lon': d_lon}}] AS pts
      FROM ({_PAIRS_SQL}) p0) p,
     LATERAL (SELECT unnest(generate_series(0, len(p.pts) - 2)) AS leg) l,
     LATERAL (SELECT unnest(generate_series(0, 8)) AS s) t""")
def q_polyline_linear(spark, sf):
    """Start + sea-lane waypoints + end, 8 steps per leg, one row per point."""
    p = _pairs(spark, sf)
    start = F.struct(F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon"))
    end = F.struct(F.col("d_lat").alias("lat"), F.col("d_lon").alias("lon"))
    p = G.with_lane_waypoints(p, "w")
    line = G.polyline_linear(start, F.col("w"), end, C.OCEAN_LEG_STEPS)
    return p.select("origin_city", "destination_city", F.posexplode_outer(line).alias("idx", "pt")).where(
        F.col("idx").isNotNull()).select(
        "origin_city", "destination_city", "idx", F.col("pt.lat").alias("lat"), F.col("pt.lon").alias("lon"))


def _gc_sql() -> str:
    la1, lo1, la2, lo2 = "radians(o_lat)", "radians(o_lon)", "radians(d_lat)", "radians(d_lon)"
    d = (f"(2 * asin(sqrt(pow(sin(({la2} - {la1}) / 2), 2) + cos({la1}) * cos({la2}) "
         f"* pow(sin(({lo2} - {lo1}) / 2), 2))))")
    f = "(CAST(i AS DOUBLE) / 80.0)"
    a = f"(sin((1.0 - {f}) * {d}) / sin({d}))"
    b = f"(sin({f} * {d}) / sin({d}))"
    x = f"({a} * cos({la1}) * cos({lo1}) + {b} * cos({la2}) * cos({lo2}))"
    y = f"({a} * cos({la1}) * sin({lo1}) + {b} * cos({la2}) * sin({lo2}))"
    z = f"({a} * sin({la1}) + {b} * sin({la2}))"
    return (f"CASE WHEN {d} = 0 THEN o_lat ELSE round(degrees(atan2({z}, sqrt({x} * {x} + {y} * {y}))), 6) END AS lat, "
            f"CASE WHEN {d} = 0 THEN o_lon ELSE round(degrees(atan2({y}, {x})), 6) END AS lon")


@register("polyline_great_circle", ["city_coordinates", "shipments"], f"""
SELECT origin_city, destination_city, CAST(i AS INTEGER) AS idx, {_gc_sql()}
FROM ({_PAIRS_SQL}) p, LATERAL (SELECT unnest(generate_series(0, 80)) AS i) g""")
def q_polyline_great_circle(spark, sf):
    """81 great-circle points per pair (rounded to 6 places; trig ulps differ across libraries)."""
    p = _pairs(spark, sf)
    line = G.polyline_great_circle("o_lat", "o_lon", "d_lat", "d_lon")
    return p.select("origin_city", "destination_city", F.posexplode_outer(line).alias("idx", "pt")).where(
        F.col("idx").isNotNull()).select(
        "origin_city", "destination_city", "idx",
        F.round("pt.lat", 6).alias("lat"), F.round("pt.lon", 6).alias("lon"))


_ROUTE_SQL = f"""
WITH r AS (
  SELECT DISTINCT origin_city, destination_city, origin_country, destination_country, carrier_type FROM requests),
p AS (
  SELECT r.*, o.lat AS o_lat, o.lon AS o_lon, d.lat AS d_lat, d.lon AS d_lon,
         upper(origin_country) = upper(destination_country) AS same
  FROM r JOIN city_coordinates o ON o.city = r.origin_city JOIN city_coordinates d ON d.city = r.destination_city),
tagged AS (
  SELECT *, CASE WHEN same AND carrier_type = 'Ocean' THEN 'none' WHEN same THEN 'direct'
                 WHEN carrier_type = 'Air' THEN 'arc' ELSE 'sea' END AS branch,
         CASE WHEN same THEN CASE carrier_type WHEN 'Ocean' THEN '' WHEN 'Air' THEN 'air' ELSE 'road' END
              WHEN carrier_type = 'Air' THEN 'air' ELSE 'ocean' END AS route_type
  FROM p),
ends AS (SELECT DISTINCT o_lat, o_lon, d_lat, d_lon, branch FROM tagged),
legs AS (
  SELECT *, CASE branch WHEN 'sea' THEN 8 ELSE 12 END AS steps,
         [{{'lat': o_lat, 'lon': o_lon}}]
           || CASE WHEN branch = 'sea' THEN {sql_lane_waypoints("o_lat", "o_lon", "d_lat", "d_lon")}
                   ELSE []::STRUCT(lat DOUBLE, lon DOUBLE)[] END
           || [{{'lat': d_lat, 'lon': d_lon}}] AS pts
  FROM ends WHERE branch IN ('sea', 'direct')),
points AS (
  SELECT o_lat, o_lon, d_lat, d_lon, branch, leg * 100 + s AS i,
         round(pts[leg + 1].lat + (pts[leg + 2].lat - pts[leg + 1].lat) * (CAST(s AS DOUBLE) / steps), 6) AS lat,
         round(pts[leg + 1].lon + (pts[leg + 2].lon - pts[leg + 1].lon) * (CAST(s AS DOUBLE) / steps), 6) AS lon
  FROM legs, LATERAL (SELECT unnest(generate_series(0, len(legs.pts) - 2)) AS leg) l,
       LATERAL (SELECT unnest(generate_series(0, legs.steps)) AS s) t
  UNION ALL
  SELECT o_lat, o_lon, d_lat, d_lon, branch, i, {_gc_sql()}
  FROM ends, LATERAL (SELECT unnest(generate_series(0, 80)) AS i) g WHERE branch = 'arc'),
shapes AS (
  SELECT o_lat, o_lon, d_lat, d_lon, branch, list(lat + 0.0 ORDER BY i) AS lats, list(lon + 0.0 ORDER BY i) AS lons
  FROM points GROUP BY ALL)
SELECT t.origin_city, t.destination_city, t.origin_country, t.destination_country, t.carrier_type, t.route_type,
       CAST(coalesce(len(s.lats), 0) AS INTEGER) AS n_points,
       coalesce(s.lats, []::DOUBLE[]) AS route_lats, coalesce(s.lons, []::DOUBLE[]) AS route_lons
FROM tagged t LEFT JOIN shapes s USING (o_lat, o_lon, d_lat, d_lon, branch)"""


@register("route_geometry", ["requests", "city_coordinates"], _ROUTE_SQL)
def q_route_geometry(spark, sf):
    """Polyline and route type per distinct (route, countries, carrier); the polyline's coordinates are rounded to 6 places."""
    r = td.typed_shipments(spark, sf).select("origin_city", "destination_city", "origin_country",
                                             "destination_country", "carrier_type").distinct()
    cc = td.city_coordinates(spark, sf)
    o = cc.select(F.col("city").alias("origin_city"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    d = cc.select(F.col("city").alias("destination_city"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    g = G.route_geometry(r.join(o, "origin_city").join(d, "destination_city"))
    rounded = lambda axis: F.transform(f"route.{axis}", lambda x: F.round(x, 6) + 0.0)  # noqa: E731 (no negative zeros)
    return g.select("origin_city", "destination_city", "origin_country", "destination_country", "carrier_type",
                    "route_type", F.size("route").alias("n_points"), rounded("lat").alias("route_lats"),
                    rounded("lon").alias("route_lons"))


_LANGUAGES = [*C.PROMPT_LANGUAGES, "Klingon"]  # the last is none of those allowed
_CLEAN = lambda c: f"trim(regexp_replace({c}, '[^A-Za-z0-9\\s_-]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


_PROMPT_SQL = f"""
WITH f AS ({_ENRICH_SQL.replace("r.shipment_id,", "r.shipment_id, r.raw_p, r.raw_days, r.reason_index,", 1)}),
x AS (
  SELECT f.*, {assemble_select("f", "f.vendor_on_time_rate", key=False)},
         {_LANGUAGES}[CAST(('0x' || substr(md5(shipment_id), 1, 8)) AS BIGINT) % {len(_LANGUAGES)} + 1] AS asked
  FROM f)
SELECT shipment_id, asked AS language, concat_ws(chr(10),
  'Shipment ' || {_CLEAN("shipment_id")} || ' from ' || {_CLEAN("origin_city")} || ', ' || {_CLEAN("origin_country")} || ' to '
    || {_CLEAN("destination_city")} || ', ' || {_CLEAN("destination_country")} || ' via vendor ' || {_CLEAN("vendor_name")} || '.',
  'Carrier type: ' || {_CLEAN("carrier_type")} || '. Distance: ' || CAST(distance_km AS VARCHAR) || ' km. Planned transit: '
    || CAST(planned_transit_days AS VARCHAR) || ' days.',
  'Weather risk score: ' || format('{{:.2f}}', weather_risk_score) || '. Hazmat: '
    || CASE WHEN is_hazmat = 1 THEN 'True' ELSE 'False' END || '. Priority: ' || {_CLEAN("priority_level")} || '.',
  'Vendor on-time rate: ' || format('{{:.1f}}', vendor_on_time_rate * 100) || '%. Vendor tier: ' || vendor_tier || '.',
  'Cross-border context: Destination LPI Score is ' || format('{{:.1f}}', destination_lpi_score) || '/5.0. Customs Tier: '
    || CAST(destination_customs_tier AS VARCHAR) || '/4. Geopolitical Risk: ' || format('{{:.2f}}', destination_geopolitical_risk)
    || '. Historical avg customs delay for this lane: ' || format('{{:.1f}}', lane_avg_customs_days) || ' days.',
  'ML prediction - delay: ' || CASE WHEN delay_predicted THEN 'True' ELSE 'False' END || '. Estimated delay: '
    || CAST(estimated_delay_days AS VARCHAR) || ' days. Reason category: ' || delay_reason || '.',
  'Adjusted delay probability: ' || format('{{:.1f}}', adjusted_delay_probability * 100) || '%.',
  'In 2 to 4 sentences, explain why this shipment is predicted to ' || CASE WHEN delay_predicted THEN 'be delayed' ELSE 'arrive on time' END
    || ' and what the supply chain manager should do about it, specifically addressing any customs or geopolitical risks if applicable.',
  'IMPORTANT: You MUST write your explanation in the ' || CASE WHEN asked = 'Klingon' THEN 'English' ELSE asked END || ' language.') AS prompt
FROM x"""


@register("explain_prompt", _ENRICH_FIX, _PROMPT_SQL)
def q_explain_prompt(spark, sf):
    """P20: the sanitized explanation prompt per scored shipment (no model call)."""
    feats = E.enrich_shipments(td.typed_shipments(spark, sf), keep=("raw_p", "raw_days", "reason_index"),
                               **_dims(spark, sf))
    shown = ("vendor_name", "origin_city", "origin_country", "destination_city", "destination_country",
             "carrier_type", "priority_level", "distance_km", "is_hazmat", "planned_transit_days",
             "weather_risk_score") + CONTEXT_COLUMNS
    rec = score_assemble(feats, keep=shown)
    asked = F.conv(F.substring(F.md5("shipment_id"), 1, 8), 16, 10).cast("long") % len(_LANGUAGES) + 1
    lang = F.element_at(F.array(*map(F.lit, _LANGUAGES)), asked.cast("int"))
    return rec.select("shipment_id", lang.alias("language"), TX.explain_prompt(lang).alias("prompt"))
