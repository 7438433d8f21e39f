"""Declared schemas and table contracts.  Nothing is inferred at ingest."""

from __future__ import annotations

from dataclasses import dataclass, field


# Input tables of the test data, as DDL that every reader accepts.
INPUT = {
    "region": ("r_regionkey int, r_name string"),
    "nation": ("n_nationkey int, n_name string, n_regionkey int"),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"),
}

# One scheduled sensor slot with its latent truth, as it arrives in monthly CSV files.
READING_CSV = ("reading_id bigint, bin_id int, timestamp_utc timestamp_ntz, service_date_local date, "
    "zone_id string, fill_level_pct float, weight_kg float, temperature_c float, "
    "battery_pct float, sensor_status string, collection_status string, "
    "arrivals_l_true float, inventory_l_true float, overflow_l_true float, "
    "removed_l_true float, capacity_l smallint, data_origin string")

# Which columns are observable and which are latent truth.
OBSERVED_COLUMNS = [
    "reading_id",
    "bin_id",
    "timestamp_utc",
    "service_date_local",
    "zone_id",
    "fill_level_pct",
    "weight_kg",
    "temperature_c",
    "battery_pct",
    "sensor_status",
    "collection_status",
    "data_origin",
]
TRUTH_COLUMNS = [
    "reading_id",
    "bin_id",
    "timestamp_utc",
    "service_date_local",
    "arrivals_l_true",
    "inventory_l_true",
    "overflow_l_true",
    "removed_l_true",
    "capacity_l",
    "data_origin",
]


@dataclass(frozen=True)
class Contract:
    """Grain of a table: its key, and the columns that refer to other tables."""

    name: str
    key: tuple[str, ...]
    foreign: dict[str, str] = field(default_factory=dict)  # column -> "table.column"


CONTRACTS = {
    c.name: c
    for c in (
        Contract("dim_city", ("city_id",)),
        Contract("dim_zone", ("zone_key",), {"city_id": "dim_city.city_id"}),
        Contract("dim_bin", ("bin_key",), {"city_id": "dim_city.city_id", "zone_key": "dim_zone.zone_key"}),
        Contract("fact_bin_readings", ("reading_id",), {"bin_key": "dim_bin.bin_key"}),
        Contract("simulation_truth", ("reading_id",), {"bin_key": "dim_bin.bin_key"}),
        Contract("collection_events", ("collection_id",), {"bin_key": "dim_bin.bin_key"}),
        Contract("bin_daily_metrics", ("bin_id", "service_date_local"), {"bin_id": "dim_bin.bin_id"}),
        Contract("zone_daily_metrics", ("zone_id", "service_date_local"), {"zone_id": "dim_zone.zone_id"}),
        Contract("city_daily_metrics", ("city_id", "service_date_local"), {"city_id": "dim_city.city_id"}),
    )
}
