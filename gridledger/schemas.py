"""Table schemas, as DDL. Registers in the operators are BIGINT hundredths ("cents"), which decoded values are exactly."""

READINGS = "device_id bigint, id bigint, captured_at timestamp_ntz, metric string, cents bigint, unit string, phase string, src string"
RAW_READINGS = READINGS + ", created_at timestamp_ntz"
SETTINGS = "device_id bigint, k string, v string"
BASELINES = "device_id bigint, cycle_start date, metric string, cents bigint, note string, updated_at timestamp_ntz"
ACTUALS = "device_id bigint, cycle_start date, amount bigint, units bigint, bill_date date, note string, updated_at timestamp_ntz"
