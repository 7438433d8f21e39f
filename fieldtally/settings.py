"""Fixed values the results depend on.  Every plan takes them as defaults only."""

# Physical and planning assumptions.
KG_PER_LITRE = 0.12
UTC_OFFSET = "INTERVAL '05:30' HOUR TO MINUTE"
EARTH_RADIUS_M = 6371000.0
DEPOT_KM_PER_ROUTE = 5.0
KM_PER_STOP = 0.35
PROXY_FLEET_SIZE = 50
KM_PER_LITRE_FUEL = 4.5
FUEL_PRICE = 92.39
CO2_KG_PER_LITRE = 2.689
TRUCK_VOLUME_L = 12000
TRUCK_PAYLOAD_KG = 5000
SHIFT_MINUTES = 480
SERVICE_MINUTES_PER_STOP = 4
UNLOAD_MINUTES = 15
REMOVED_SHARE = 0.95
SLOT_MINUTES = 120
STALE_SENSOR_HOURS = 6
MAX_SNAP_M = 100
PILOT_SIZE = 60
TRUCK_TONNES = 12
TRUCK_HEIGHT_M = 3.5
TRUCK_WIDTH_M = 2.5

# Report thresholds.
EARLY_BELOW_PCT = 35
LATE_FROM_PCT = 95
MIN_DAYS = 300
MIN_ATTEMPTS = 100
ANOMALY_HISTORY = 28
ANOMALY_Z = 3
LOW_STOPS = 4

SUCCESS = ("collected", "partial")
ATTEMPTED = ("collected", "partial", "missed")

# Allowed provenance tags.
ORIGINS = ("official", "real", "derived", "proxy", "synthetic", "assumption")

# Road classes and the speed in km/h assumed for each.
ROAD_SPEED_KMH = {
    "motorway": 50,
    "motorway_link": 30,
    "trunk": 40,
    "trunk_link": 25,
    "primary": 35,
    "primary_link": 25,
    "secondary": 30,
    "secondary_link": 20,
    "tertiary": 25,
    "tertiary_link": 20,
    "unclassified": 20,
    "residential": 15,
    "service": 15,
    "living_street": 10,
}

# Fixed value: a limit tag is one number with an optional unit.
LIMIT_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*(?:t|tonnes?|m|meters?)?\s*$"
