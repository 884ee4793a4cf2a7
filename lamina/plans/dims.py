"""Dimension builders: calendar, minutes of the day, static code lists, and declarations of the changing ones."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lamina.functions.scalar import calendar_columns, minute_columns
from lamina.operators.conforming import scd1_merge, scd2_merge, seed_unknown, surrogate_keys
from lamina.sources.files import dates, numbers


def calendar(spark: SparkSession, first: str, last: str, *, unknown: bool = True) -> DataFrame:
    d = dates(spark, first, last).select(*[c.alias(n) for n, c in calendar_columns("d").items()])
    return seed_unknown(d, key="date_key", business_key="day_name", members={-1: "UNKNOWN"}) if unknown else d


def minutes(spark: SparkSession, *, unknown: bool = True) -> DataFrame:
    d = numbers(spark, 0, 1439).select(*[c.alias(n) for n, c in minute_columns("n").items()])
    return seed_unknown(d, key="time_key", business_key="clock", members={-1: "UNKNOWN"}) if unknown else d


@dataclass(frozen=True)
class Dim:
    name: str
    business_key: str
    kind: str  # scd1 or scd2
    tracked: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name.removeprefix('dim_')}_key"


DIMS = {
    d.name: d
    for d in (
        Dim("dim_patient", "patient_golden_id", "scd2", ("sex", "age_band", "fsa", "preferred_language", "is_deceased")),
        Dim("dim_hospital", "hospital_id", "scd2", ("hospital_name", "facility_type", "region", "licensed_beds")),
        Dim("dim_department", "department_id", "scd2", ("department_name", "service_line", "hospital_id", "is_inpatient_unit")),
        Dim("dim_bed", "bed_id", "scd2", ("ward_name", "ward_type", "bed_type", "department_id", "is_active")),
        Dim("dim_doctor", "doctor_id", "scd2", ("primary_department_id", "specialty", "sub_specialty", "employment_type", "fte", "is_active")),
        Dim("dim_diagnosis", "diagnosis_code", "scd1"),
        Dim("dim_lab_test", "loinc_code", "scd1"),
        Dim("dim_medication", "din", "scd1"),
        Dim("dim_insurance_provider", "payer_id", "scd1"),
        Dim("dim_admission_type", "admission_type", "scd1"),
        Dim("dim_discharge_disposition", "disposition_code", "scd1"),
        Dim("dim_appointment_status", "status_code", "scd1"),
        Dim("dim_claim_status", "claim_status_code", "scd1"),
    )
}


def load_dim(dim: Dim, current: DataFrame | None, incoming: DataFrame, *, run_ts: str) -> DataFrame:
    """The dimension after a load, with its special members."""
    if dim.kind == "scd2":
        out = scd2_merge(current, incoming, business_key=dim.business_key, tracked=list(dim.tracked), key=dim.key, run_ts=run_ts)
    elif current is None:
        out = surrogate_keys(incoming.dropDuplicates([dim.business_key]), [dim.business_key], dim.key)
    else:
        out = scd1_merge(current, incoming, business_key=dim.business_key, key=dim.key)
    return seed_unknown(out, key=dim.key, business_key=dim.business_key)


def static_dim(spark: SparkSession, rows: Iterable[tuple], ddl: str, dim: Dim) -> DataFrame:
    return load_dim(dim, None, spark.createDataFrame(list(rows), ddl), run_ts="1900-01-01 00:00:00")
