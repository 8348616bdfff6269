"""Fixed values that results depend on.

FIXED VALUES: every constant below must equal the behaviour being
reproduced (defaults on lookup miss, category maps, thresholds, score
weights, sea-lane waypoints and region rules). They are stated here once,
in natural order, and used everywhere else by name.
"""

from __future__ import annotations

# ---------------------------------------------------------------- defaults
# Vendor lookup miss.
VENDOR_DEFAULT_ON_TIME_RATE = 0.5
VENDOR_DEFAULT_AVG_DELAY_DAYS = 2.0
VENDOR_DEFAULT_TOTAL_SHIPMENTS = 0
# Route lookup miss.
ROUTE_DEFAULT_AVG_DELAY_DAYS = 2.0
ROUTE_DEFAULT_HISTORICAL_COUNT = 0
# Country-risk lookup miss.
COUNTRY_DEFAULT_LPI = 3.0
COUNTRY_DEFAULT_CUSTOMS_TIER = 2
COUNTRY_DEFAULT_GEO_RISK = 0.2
COUNTRY_DEFAULT_PORT_CONGESTION = 1.0
# Trade-lane and weather lookup miss.
LANE_DEFAULT_CUSTOMS_DAYS = 2.5
WEATHER_DEFAULT_RISK = 0.1

# Raw order parsing defaults (training path).
RAW_DEFAULT_REAL_DAYS = 0.0
RAW_DEFAULT_SCHED_DAYS = 0.0
RAW_DEFAULT_QUANTITY = 1.0
RAW_DEFAULT_PRICE = 2.0
RAW_DEFAULT_COUNTRY = "US"          # used when the country column is absent
NULL_TEXT = "nan"                   # text of a missing value after str()
WEIGHT_PER_PRICE = 0.5
WEIGHT_MIN, WEIGHT_MAX = 1.0, 50000.0
WEIGHT_PER_VOLUME = 500.0
TRAINING_DISTANCE_KM = 500.0
TRAINING_NUM_STOPS = 1
RAW_DATE_FORMAT = "M/d/yyyy H:mm"   # our assumption for the order-date text

# Scoring-path feature defaults for missing request fields.
SCORING_DEFAULTS = {
    "cargo_weight_kg": 1.0,
    "cargo_volume_m3": 1.0,
    "distance_km": 1.0,
    "num_stops": 0,
    "scheduled_transit_days": 2,
    "weather_risk_score": 0.1,
    "carrier_type": "FTL",
    "priority_level": "MEDIUM",
}

# --------------------------------------------------------- category maps
SHIPPING_MODE_TO_CARRIER = {
    "Standard Class": "FTL",
    "Second Class": "LTL",
    "First Class": "FTL",
    "Same Day": "Intermodal",
}
CARRIER_FALLBACK = "FTL"
SHIPPING_MODE_TO_PRIORITY = {
    "Same Day": "CRITICAL",
    "First Class": "HIGH",
    "Second Class": "MEDIUM",
    "Standard Class": "LOW",
}
PRIORITY_FALLBACK = "MEDIUM"

# Ordinal encoder category order; unknown -> -1.
CARRIER_TYPES = ["FTL", "LTL", "Intermodal", "Ocean", "Air"]
PRIORITY_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
UNKNOWN_CATEGORY_CODE = -1

# k-means cluster index -> reason label.
REASON_LABELS = ["WEATHER", "VENDOR", "ROUTE", "CUSTOMS"]

# ------------------------------------------------------------ thresholds
DELAY_THRESHOLD = 0.5
WEEKEND_DAYS = (5, 6)               # Monday = 0

# Vendor tier adjustment.
TIER_EXCELLENT_MIN_RATE = 0.65
TIER_AVERAGE_MIN_RATE = 0.50
TIER_EXCELLENT_SHIFT = -0.10
TIER_POOR_SHIFT = 0.15

# Country risk score = (5 - lpi) * 2 + tier * 1.5 + geo * 5 + port * 0.5.
COUNTRY_SCORE_HIGH = 15.0           # strictly greater
COUNTRY_SCORE_MEDIUM = 8.0          # strictly greater

# Display band on the rounded percent.
BAND_HIGH_PCT = 70
BAND_MODERATE_PCT = 40

# Weather risk: weights and saturation points, rounded to 4 places.
WEATHER_PRECIP_WEIGHT, WEATHER_PRECIP_SAT = 0.50, 30.0
WEATHER_WIND_WEIGHT, WEATHER_WIND_SAT = 0.35, 70.0
WEATHER_SNOW_WEIGHT, WEATHER_SNOW_SAT = 0.15, 10.0

# Input validation limits (inclusive upper bounds, exclusive lower unless noted).
LIMITS = {
    "shipment_id_len": (1, 64),
    "vendor_name_len": (1, 128),
    "city_len": (1, 64),
    "country_len": (2, 64),
    "scheduled_transit_days": (0, 365),
    "cargo_weight_kg": (0.0, 50000.0),
    "cargo_volume_m3": (0.0, 200.0),
    "distance_km": (0.0, 25000.0),
    "num_stops": (0, 50),          # inclusive both ends
}

# Sanitizer: keep only these characters (then trim whitespace).

# Prompt languages; anything else falls back to English.
PROMPT_LANGUAGES = ["English", "Hindi", "Marathi", "Gujarati", "Tamil",
                    "Arabic", "French", "Spanish", "German"]

# Earth radius used to turn the central angle into km (our constant).
EARTH_RADIUS_KM = 6371.0088
GREAT_CIRCLE_POINTS = 80            # segments; 81 points
OCEAN_LEG_STEPS = 8
DOMESTIC_LEG_STEPS = 12

# Sea-lane waypoints (lat, lon), in the order they are defined.
WAYPOINTS = {
    "GIBRALTAR": (35.98, -5.45),
    "MED_CENTER": (35.5, 18.0),
    "SUEZ_NORTH": (31.25, 32.33),
    "SUEZ_SOUTH": (29.94, 32.55),
    "BAB_EL_MANDEB": (12.58, 43.47),
    "ADEN": (12.78, 45.02),
    "ARABIAN_SEA": (15.0, 65.0),
    "HORMUZ": (26.56, 56.46),
    "INDIAN_OCEAN_W": (-5.0, 60.0),
    "INDIAN_OCEAN_E": (-5.0, 90.0),
    "MALACCA_W": (5.5, 99.5),
    "MALACCA_E": (1.2, 104.5),
    "SOUTH_CHINA_SEA": (12.0, 115.0),
    "CAPE_GOOD_HOPE": (-34.5, 20.0),
    "CAPE_HORN": (-55.9, -67.3),
    "PANAMA_ATLANTIC": (9.38, -79.9),
    "PANAMA_PACIFIC": (8.9, -79.5),
    "N_ATLANTIC_MID": (48.0, -30.0),
    "N_PACIFIC_MID": (45.0, 180.0),
    "N_PACIFIC_MID2": (45.0, -170.0),
    "S_PACIFIC_MID": (-30.0, -130.0),
    "AUSTRALIA_W": (-25.0, 110.0),
    "AUSTRALIA_S": (-40.0, 145.0),
}

# Region of a point: first matching rule wins. Each rule is a list of
# (axis, op, value) bounds that must all hold; op is ge / gt / lt.
REGION_RULES = [
    ("east_asia", [("lon", "ge", 100), ("lat", "ge", 20)]),
    ("sea", [("lon", "ge", 95), ("lat", "lt", 20), ("lat", "gt", -15)]),
    ("south_asia", [("lon", "ge", 60), ("lon", "lt", 100), ("lat", "gt", -10)]),
    ("middle_east", [("lon", "ge", 30), ("lon", "lt", 70), ("lat", "ge", 10), ("lat", "lt", 40)]),
    ("europe", [("lon", "ge", -15), ("lon", "lt", 55), ("lat", "ge", 30)]),
    ("africa", [("lon", "ge", -20), ("lon", "lt", 55), ("lat", "lt", 30)]),
    ("australia", [("lon", "ge", 110), ("lat", "lt", -10)]),
    ("north_america", [("lon", "ge", -130), ("lon", "lt", -60), ("lat", "ge", 15)]),
    ("south_america", [("lon", "ge", -85), ("lon", "lt", -30), ("lat", "lt", 15)]),
    ("south_america", [("lon", "ge", -130), ("lon", "lt", -30), ("lat", "lt", 15)]),
]
REGION_OTHER = "other"

# Sea-lane rules, first match wins:
# (origin regions, destination regions, side condition, waypoint names).
# The behaviour reproduced also lists the Australia -> East/South-East Asia
# pair a second time with reversed waypoints; the first listing always
# matches first, so that duplicate can never apply and is not repeated here.
# A side condition is (point, axis, op, value) on the origin ("s") or
# destination ("e") point, or None. Bare [lat, lon] points are given inline.
_EA = ("east_asia", "sea")
LANE_RULES = [
    (_EA, ("europe",), None,
     ["MALACCA_W", "INDIAN_OCEAN_W", "ADEN", "BAB_EL_MANDEB", "SUEZ_SOUTH", "SUEZ_NORTH", "MED_CENTER"]),
    (("europe",), _EA, None,
     ["MED_CENTER", "SUEZ_NORTH", "SUEZ_SOUTH", "BAB_EL_MANDEB", "ADEN", "INDIAN_OCEAN_W", "MALACCA_W"]),
    (("south_asia",), ("europe",), None,
     ["ARABIAN_SEA", "ADEN", "BAB_EL_MANDEB", "SUEZ_SOUTH", "SUEZ_NORTH", "MED_CENTER"]),
    (("europe",), ("south_asia",), None,
     ["MED_CENTER", "SUEZ_NORTH", "SUEZ_SOUTH", "BAB_EL_MANDEB", "ADEN", "ARABIAN_SEA"]),
    (("middle_east",), ("europe",), ("s", "lon", "gt", 50),
     ["HORMUZ", "ARABIAN_SEA", "ADEN", "BAB_EL_MANDEB", "SUEZ_SOUTH", "SUEZ_NORTH", "MED_CENTER"]),
    (("middle_east",), ("europe",), None,
     ["BAB_EL_MANDEB", "SUEZ_SOUTH", "SUEZ_NORTH", "MED_CENTER"]),
    (("europe",), ("middle_east",), ("e", "lon", "gt", 50),
     ["MED_CENTER", "SUEZ_NORTH", "SUEZ_SOUTH", "BAB_EL_MANDEB", "ADEN", "ARABIAN_SEA", "HORMUZ"]),
    (("europe",), ("middle_east",), None,
     ["MED_CENTER", "SUEZ_NORTH", "SUEZ_SOUTH", "BAB_EL_MANDEB"]),
    (_EA, ("north_america",), ("s", "lon", "gt", 120),
     ["N_PACIFIC_MID", "N_PACIFIC_MID2"]),
    (_EA, ("north_america",), None,
     ["MALACCA_E", (10.0, 140.0), "N_PACIFIC_MID", "N_PACIFIC_MID2"]),
    (("north_america",), _EA, None,
     [(50.0, -170.0), "N_PACIFIC_MID", (10.0, 140.0)]),
    (("south_america",), ("east_asia",), ("s", "lon", "lt", -70),
     ["PANAMA_PACIFIC", (10.0, 140.0), "N_PACIFIC_MID2"]),
    (("south_america",), ("east_asia",), None,
     ["CAPE_HORN", "S_PACIFIC_MID", (10.0, 140.0)]),
    (("south_america",), ("europe",), None,
     [(0.0, -30.0), "N_ATLANTIC_MID"]),
    (("africa",), _EA, None,
     ["CAPE_GOOD_HOPE", "INDIAN_OCEAN_W", "INDIAN_OCEAN_E", "MALACCA_W"]),
    (_EA, ("africa",), None,
     ["MALACCA_W", "INDIAN_OCEAN_E", "INDIAN_OCEAN_W", "CAPE_GOOD_HOPE"]),
    (("africa",), ("europe",), ("s", "lon", "gt", 35),
     ["BAB_EL_MANDEB", "SUEZ_SOUTH", "SUEZ_NORTH", "MED_CENTER"]),
    (("africa",), ("europe",), None,
     [(20.0, -10.0), "GIBRALTAR"]),
    (("europe",), ("africa",), ("e", "lon", "gt", 35),
     ["MED_CENTER", "SUEZ_NORTH", "SUEZ_SOUTH", "BAB_EL_MANDEB"]),
    (("europe",), ("africa",), None,
     ["GIBRALTAR", (20.0, -10.0)]),
    (("africa",), ("south_asia",), ("s", "lon", "gt", 35),
     ["INDIAN_OCEAN_W"]),
    (("africa",), ("south_asia",), None,
     ["CAPE_GOOD_HOPE", "INDIAN_OCEAN_W"]),
    (("south_asia",), ("africa",), ("e", "lon", "gt", 35),
     ["INDIAN_OCEAN_W"]),
    (("south_asia",), ("africa",), None,
     ["INDIAN_OCEAN_W", "CAPE_GOOD_HOPE"]),
    (("europe",), ("north_america",), None,
     ["GIBRALTAR", "N_ATLANTIC_MID"]),
    (("north_america",), ("europe",), None,
     ["N_ATLANTIC_MID", "GIBRALTAR"]),
    (("australia",), _EA, None,
     ["AUSTRALIA_W", "MALACCA_W"]),
    (("australia",), ("europe",), None,
     ["AUSTRALIA_W", "INDIAN_OCEAN_E", "INDIAN_OCEAN_W", "ADEN", "SUEZ_SOUTH", "SUEZ_NORTH", "MED_CENTER"]),
    (("europe",), ("australia",), None,
     ["MED_CENTER", "SUEZ_NORTH", "SUEZ_SOUTH", "ADEN", "INDIAN_OCEAN_W", "INDIAN_OCEAN_E", "AUSTRALIA_W"]),
    (("africa",), ("middle_east",), ("s", "lon", "gt", 35),
     ["BAB_EL_MANDEB", "ADEN", "ARABIAN_SEA"]),
]
