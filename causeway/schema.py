"""Schemas of the tables that operators take and return, as DDL."""

from __future__ import annotations

STATES = ("Good", "Fair", "Poor", "Severe")
N_STATES = len(STATES)

NODES = "node_id STRING, x DOUBLE, y DOUBLE, kind STRING"
EDGES = "src STRING, dst STRING, length_m DOUBLE, road_class STRING, speed_kph DOUBLE, travel_time_min DOUBLE"
HABITATIONS = "node_id STRING, population DOUBLE"
FACILITIES = "facility_type STRING, node_id STRING"
SERVICES = "facility_type STRING, cap_min DOUBLE, weight DOUBLE"
STRUCTURES = "ord INT, asset_id STRING, node_id STRING, structure_type STRING"
SCENARIOS = "s INT, y INT, ord INT, rain DOUBLE, det_u DOUBLE, fail_u DOUBLE"
OUTCOMES = "policy STRING, s INT, person_days DOUBLE, planned DOUBLE, emergency DOUBLE"
TRANSITIONS = "age_class INT, s INT, s_next INT, n DOUBLE, p DOUBLE"
PANEL = (
    "state_code STRING, structure_id STRING, key STRING, year INT, year_built DOUBLE, year_rehab DOUBLE, material DOUBLE,"
    " design_load DOUBLE, spans DOUBLE, max_span_m DOUBLE, struct_len_m DOUBLE, deck_width_m DOUBLE, adt DOUBLE,"
    " truck_pct DOUBLE, rating INT, state4 INT, age DOUBLE, years_since_rehab DOUBLE"
)
