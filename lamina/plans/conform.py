"""Typed entities: each source is declared once and conformed by one function."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalar import (
    cast_columns,
    flag,
    is_cancelled,
    left_unseen,
    level_1_to_5,
    minutes_between,
    stay_days,
    stay_hours,
    without_codes,
)
from lamina.operators.conforming import latest, map_codes, resolve
from lamina.operators.quality import quarantine


@dataclass(frozen=True)
class EntitySpec:
    """Dedupe keys, casts, code mappings (column -> domain, system, target), patient systems, derived columns, rule.

    Names and lists in the specs below that sources dictate (columns, domains, placeholder codes) are fixed values.
    """

    name: str
    keys: tuple[str, ...]
    casts: Mapping[str, str] = field(default_factory=dict)
    mappings: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)
    patient: tuple[str, tuple[str, ...]] | None = None
    derived: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    rule: str | None = None


_c = F.col
_lag = lambda a, b: lambda: minutes_between(a, b)
_money = "decimal(18,2)"
_times = lambda *names: dict.fromkeys(names, "timestamp")

SPECS = {
    s.name: s
    for s in (
        EntitySpec(
            "admission", ("admission_id",), _times("admission_ts", "discharge_ts", "expected_discharge_ts"),
            {"admission_type": ("ADMIT_TYPE", "EHR", "admission_type_std"), "discharge_disposition_code": ("DISPOSITION", "EHR", "disposition_std")}, ("patient_id", ("EHR",)),
            {
                # a discharge before the admission is a clock error: the stay counts as open
                "discharge_ts": lambda: F.when(_c("discharge_ts") >= _c("admission_ts"), _c("discharge_ts")), "length_of_stay_days": lambda: stay_days("admission_ts", "discharge_ts"),
                "length_of_stay_hours": lambda: stay_hours("admission_ts", "discharge_ts"), "is_open": lambda: _c("discharge_ts").isNull(),
            }, "admission_ts IS NOT NULL",
        ),
        EntitySpec(
            "emergency_visit", ("ed_visit_id",), _times("arrival_ts", "triage_ts", "physician_seen_ts", "admit_decision_ts", "bed_assigned_ts", "departure_ts"), {}, ("patient_id", ("EHR",)),
            {
                "ctas_level": lambda: level_1_to_5("triage_score"), "arrival_to_triage_min": _lag("arrival_ts", "triage_ts"), "arrival_to_physician_min": _lag("arrival_ts", "physician_seen_ts"),
                "physician_to_decision_min": _lag("physician_seen_ts", "admit_decision_ts"), "decision_to_bed_min": _lag("admit_decision_ts", "bed_assigned_ts"), "ed_length_of_stay_min": _lag("arrival_ts", "departure_ts"),
                "left_without_being_seen": lambda: left_unseen("physician_seen_ts", "departure_ts"), "resulted_in_admission": lambda: flag("resulted_in_admission"),
            }, "arrival_ts IS NOT NULL",
        ),
        EntitySpec(
            "appointment", ("appointment_id",), _times("booking_ts", "scheduled_ts", "checkin_ts", "seen_ts", "checkout_ts", "cancellation_ts"), {}, ("patient_ref", ("SCHED", "EHR")),
            {
                "is_completed": lambda: _c("status_code") == "COMPLETED", "is_no_show": lambda: _c("status_code") == "NO_SHOW", "is_cancelled": lambda: is_cancelled("status_code"),
                "lead_time_days": lambda: F.datediff("scheduled_ts", "booking_ts"), "cancellation_notice_hours": lambda: stay_hours("cancellation_ts", "scheduled_ts"),
                "wait_minutes": lambda: stay_hours("checkin_ts", "seen_ts") * 60, "duration_minutes": lambda: stay_hours("seen_ts", "checkout_ts") * 60,
            }, "scheduled_ts IS NOT NULL",
        ),
        EntitySpec(
            "lab_result", ("placer_order_id", "loinc_code", "set_id"), {"result_value_numeric": "decimal(18,4)"} | _times("order_ts", "collect_ts", "result_ts"), {}, ("patient_id", ("EHR",)),
            {
                "is_abnormal": lambda: F.coalesce(_c("abnormal_flag").isin("H", "L", "HH", "LL", "A", "AA"), F.lit(False)), "is_critical": lambda: F.coalesce(_c("abnormal_flag").isin("HH", "LL", "AA"), F.lit(False)),
                "turnaround_min": lambda: stay_hours("collect_ts", "result_ts") * 60, "loinc_code": lambda: without_codes("loinc_code", ("", "LOCAL-99", "XX-000", "PENDING")),
            }, "turnaround_min IS NULL OR turnaround_min >= 0",
        ),
        EntitySpec(
            "medication_order", ("medication_order_id",), dict.fromkeys(("quantity_ordered", "quantity_dispensed", "unit_cost", "total_cost"), "decimal(12,4)") | {"days_supply": "int"} | _times("order_ts", "dispense_ts"), {}, ("patient_id", ("EHR",)),
            {"din": lambda: without_codes("din", ("", "00000000", "LOCAL01")), "order_to_dispense_min": _lag("order_ts", "dispense_ts")},
        ),
        EntitySpec("billing_line", ("invoice_id", "invoice_line_number"), {"quantity": "decimal(12,2)"} | dict.fromkeys(("charge_amount", "discount_amount", "tax_amount", "net_amount", "payment_amount", "outstanding_amount"), _money), {}, ("patient_id", ("EHR",))),
        EntitySpec(
            "survey_response", ("survey_response_id",), dict.fromkeys(("overall_score", "wait_time_score", "staff_courtesy_score", "cleanliness_score", "communication_score", "pain_management_score", "would_recommend_score"), "int") | {"response_date": "date", "service_date": "date"},
            {}, ("patient_id", ("EHR",)), {}, "overall_score BETWEEN 1 AND 10",
        ),
        EntitySpec("diagnosis", ("encounter_id", "diagnosis_code", "diagnosis_rank"), {"diagnosis_rank": "int", "is_primary": "boolean", "is_present_on_admission": "boolean", "diagnosis_date": "date"}),
        EntitySpec("bed_assignment", ("admission_id", "bed_id", "assignment_start_ts"), _times("assignment_start_ts", "assignment_end_ts"), rule="assignment_start_ts IS NOT NULL"),
        EntitySpec("hospital", ("hospital_id",)), EntitySpec("department", ("department_id",)), EntitySpec("bed", ("bed_id",)), EntitySpec("doctor", ("doctor_id",)),
    )
}


def conform(raw: DataFrame, spec: EntitySpec, *, order: list[str], mapping: DataFrame | None = None, xref: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows with reason): newest row per key, casts, mapped codes, golden id, derived columns, rule."""
    df = latest(raw, list(spec.keys), order)
    df = cast_columns(df, {c: t for c, t in spec.casts.items() if c in df.columns})
    if mapping is not None:
        for source, (domain, system, target) in spec.mappings.items():
            df = map_codes(df, mapping, domain=domain, system=system, source=source, target=target)
    if xref is not None and spec.patient:
        col, systems = spec.patient
        df = resolve(df, xref, [F.concat(F.lit(f"{s}|"), F.col(col)) for s in systems], uid="record_uid", golden="patient_golden_id", out="patient_golden_id")
    for name, make in spec.derived.items():  # in order: later ones may use earlier ones
        df = df.withColumn(name, make())
    return quarantine(df, spec.rule or "true", f"{spec.name}: {spec.rule}")
