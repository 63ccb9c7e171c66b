"""Schemas, vocabularies and fixed names of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Staging columns in their file order, and source field names that differ from them.
STAGING_COLUMNS = (
    "unique_key created_date closed_date agency agency_name complaint_type descriptor additional_details location_type "
    "incident_zip incident_address street_name cross_street_1 cross_street_2 intersection_street_1 intersection_street_2 "
    "address_type city landmark facility_type status due_date resolution_description resolution_updated_date "
    "community_board council_district police_precinct bbl borough x_coordinate y_coordinate channel_type "
    "park_facility_name park_borough vehicle_type taxi_company_borough taxi_pickup_location bridge_highway_name "
    "bridge_highway_direction road_ramp bridge_highway_segment latitude longitude location_raw"
).split()
RENAMED_FIELDS = {
    "resolution_action_updated_date": "resolution_updated_date",
    "x_coordinate_state_plane": "x_coordinate",
    "y_coordinate_state_plane": "y_coordinate",
    "open_data_channel_type": "channel_type",
    "taxi_pick_up_location": "taxi_pickup_location",
}
# Fixed value: what the encoding model expects in front of a question, and never in front of a document.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
# The controlled vocabularies.
DOMAINS = ["drainage", "water_supply", "sanitation", "street_infrastructure", "other"]
FAILURE_MODES = ["blockage", "overflow", "structural_damage", "odor", "debris", "service_gap"]
AGENCIES = ["DSNY", "DEP", "DOT", "HPD", "NYPD", "DOHMH", "DPR"]
MODE_DOMAINS = ["drainage", "sanitation"]

STAGING = T.StructType([T.StructField(c, T.StringType()) for c in STAGING_COLUMNS])
TIMESTAMPS = ("created_date", "closed_date", "due_date", "resolution_updated_date")
GROUPED_DOUBLES = ("x_coordinate", "y_coordinate")
PLAIN_DOUBLES = ("latitude", "longitude")


def _raw_type(name: str) -> T.DataType:
    if name == "unique_key":
        return T.LongType()
    if name in TIMESTAMPS:
        return T.TimestampNTZType()
    return T.DoubleType() if name in GROUPED_DOUBLES + PLAIN_DOUBLES else T.StringType()


RAW = T.StructType([*(T.StructField(c, _raw_type(c)) for c in STAGING_COLUMNS if c != "location_raw"), T.StructField("source", T.StringType()), T.StructField("ingested_at", T.TimestampType())])
FACETS = T.StructType([
    T.StructField("embed_text", T.StringType(), False), T.StructField("problem_domain", T.StringType()), T.StructField("failure_mode", T.StringType()),
    T.StructField("agencies_involved", T.ArrayType(T.StringType())), T.StructField("rationale", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("prompt_version", T.StringType()), T.StructField("needs_review", T.BooleanType()), T.StructField("review_reason", T.StringType()),
])
TEXT_CACHE = T.StructType([T.StructField("model", T.StringType(), False), T.StructField("embed_text", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType(), False)), T.StructField("dim", T.IntegerType())])
