"""Named queries of entities, facts and measures over the feeds, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.spelling import BLANKS, plain_id
from lamina.operators import conforming, occupancy
from lamina.plans import conform, facts, feeds, measures
from lamina.plans.measures import MEASURES
from lamina.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    f.__name__ = name
    QUERIES[name], SQL[name] = f, sql


# --- SQL helpers -------------------------------------------------------------------------------


def _newest(name: str) -> str:
    """Newest delivery per key of a feed."""
    by = ", ".join(f"{c} desc" for c in feeds.ORDER[name])
    return f"(select * from (select *, row_number() over (partition by {', '.join(conform.SPECS[_ENTITY[name]].keys)} order by {by}) as rn from ({feeds.plain(feeds.FEEDS[name])})) where rn = 1)"


_ENTITY = {k: k for k in feeds.FEEDS} | {"facility": "hospital", "unit": "department"}


def _mins(a: str, b: str) -> str:
    return f"(case when {b} >= {a} then round((epoch({b}) - epoch({a})) / 60.0, 6) end)::double"


def _hours(a: str, b: str) -> str:
    return f"round((epoch({b}) - epoch({a})) / 3600.0, 6)::double"


_X = feeds.plain(feeds.XREF)


def _golden(*ids: str) -> tuple[str, str]:
    """Joins of the cross-reference and the first golden identifier found."""
    joins = " ".join(f"left join (select record_uid r, min(patient_golden_id) g from ({_X}) group by 1) x{i} on x{i}.r = {u}" for i, u in enumerate(ids))
    return joins, f"coalesce({', '.join(f'x{i}.g' for i in range(len(ids)))})" if len(ids) > 1 else "x0.g"


def _resolved(name: str, cols: str, *uids: str) -> str:
    j, g = _golden(*uids)
    return f"(select s.*, {g} as patient_golden_id{cols} from {_newest(name)} s {j})"


def _id(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^{BLANKS}+|{BLANKS}+$', '', 'g')), '')"


def _code(c: str) -> str:
    return f"case when {_id(c)} is not null then upper(regexp_replace({c}, '{BLANKS}|[.]', '', 'g')) end"


def _key(f: str, by: str, dim: str, out: str, at: str | None = None, code: bool = False) -> str:
    """Scalar column: surrogate key of a fact row ``f``, -1 where none."""
    key, bk, _ = feeds.DIMS[dim]
    src = feeds.dim_sql(dim)
    if at:
        return f"coalesce((select d.{key} from ({src}) d where d.{bk} = {f}.{by} and d.effective_from_ts <= {f}.{at} and {f}.{at} < d.effective_to_ts), -1)::bigint as {out}"
    cur = " where is_current" if "is_current" in src else ""
    left, right = (_code(bk), _code(f"{f}.{by}")) if code else (bk, f"{f}.{by}")
    return f"coalesce((select max(d.{key}) from (select * from ({src}){cur}) d where {left} = {right}), -1)::bigint as {out}"


def _date_key(c: str, out: str) -> str:
    return f"coalesce(cast(strftime({c}, '%Y%m%d') as int), -1) as {out}"


def _time_key(c: str, out: str) -> str:
    return f"coalesce((hour({c}) * 60 + minute({c}))::int, -1) as {out}"


# --- entities ----------------------------------------------------------------------------------


def xref(spark: SparkSession, d: str) -> DataFrame:
    return feeds.run(spark, d, feeds.XREF)


def silver(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Accepted rows of a feed."""
    return conform.conform(feeds.feed(spark, d, name), conform.SPECS[_ENTITY[name]], order=feeds.ORDER[name], xref=xref(spark, d))[0]


def rejected(spark: SparkSession, d: str, name: str) -> DataFrame:
    return conform.conform(feeds.feed(spark, d, name), conform.SPECS[_ENTITY[name]], order=feeds.ORDER[name], xref=xref(spark, d))[1]


_P = "'EHR|' || s.patient_id"
_ED = _resolved("emergency_visit", f""", case when try_cast(triage_score as int) between 1 and 5 then try_cast(triage_score as int) end as ctas_level, {_mins('arrival_ts', 'triage_ts')} as arrival_to_triage_min, {_mins('arrival_ts', 'physician_seen_ts')} as arrival_to_physician_min,
 {_mins('physician_seen_ts', 'admit_decision_ts')} as physician_to_decision_min, {_mins('admit_decision_ts', 'bed_assigned_ts')} as decision_to_bed_min, {_mins('arrival_ts', 'departure_ts')} as ed_length_of_stay_min, physician_seen_ts is null and departure_ts is not null as left_without_being_seen, resulted_in_admission = '1' as was_admitted""", _P)
_AP = _resolved("appointment", f""", status_code = 'COMPLETED' as is_completed, status_code = 'NO_SHOW' as is_no_show, status_code like 'CANCELLED%' as is_cancelled, date_diff('day', booking_ts, scheduled_ts)::int as lead_time_days, {_hours('cancellation_ts', 'scheduled_ts')} as cancellation_notice_hours,
 round((epoch(seen_ts) - epoch(checkin_ts)) / 60.0, 6)::double as wait_minutes, round((epoch(checkout_ts) - epoch(seen_ts)) / 60.0, 6)::double as duration_minutes""", "'SCHED|' || s.patient_ref", "'EHR|' || s.patient_ref")
_LAB = _resolved("lab_result", """, round((epoch(result_ts) - epoch(collect_ts)) / 60.0, 6)::double as turnaround_min, coalesce(abnormal_flag in ('H', 'L', 'HH', 'LL', 'A', 'AA'), false) as is_abnormal, coalesce(abnormal_flag in ('HH', 'LL', 'AA'), false) as is_critical,
 case when loinc_code not in ('', 'LOCAL-99', 'XX-000', 'PENDING') then loinc_code end as loinc""", _P)
_MED = _resolved("medication_order", f", case when din not in ('', '00000000', 'LOCAL01') then din end as din2, {_mins('order_ts', 'dispense_ts')} as order_to_dispense_min", _P)
_BILL = _resolved("billing_line", "", _P)
_SURV = _resolved("survey_response", "", _P)

_R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

_ED_COLS = ["ed_visit_id", "patient_golden_id", "ctas_level", "arrival_to_triage_min", "arrival_to_physician_min", "physician_to_decision_min", "decision_to_bed_min", "ed_length_of_stay_min", "left_without_being_seen", "resulted_in_admission"]
_AP_COLS = ["appointment_id", "patient_golden_id", "is_completed", "is_no_show", "is_cancelled", "lead_time_days", "cancellation_notice_hours", "wait_minutes", "duration_minutes"]


def _silver_query(name: str, cols: list[str], sql: str, rounds: tuple[str, ...] = ()) -> None:
    _add(f"silver_{name}", lambda spark, d: _R6(silver(spark, d, name), *rounds).select(*cols), sql)


_silver_query("emergency_visit", _ED_COLS, f"select {', '.join(_ED_COLS[:-1])}, was_admitted as resulted_in_admission from {_ED} where arrival_ts is not null", tuple(_ED_COLS[3:8]))
_silver_query("appointment", _AP_COLS, f"select {', '.join(_AP_COLS)} from {_AP} where scheduled_ts is not null", ("cancellation_notice_hours", "wait_minutes", "duration_minutes"))
_silver_query("lab_result", ["placer_order_id", "loinc_code", "set_id", "l_partkey", "patient_golden_id", "result_value_numeric", "is_abnormal", "is_critical", "turnaround_min"], f"select placer_order_id, loinc as loinc_code, set_id, l_partkey, patient_golden_id, cast(result_value_numeric as decimal(18, 4)) as result_value_numeric, is_abnormal, is_critical, turnaround_min from {_LAB} where turnaround_min is null or turnaround_min >= 0", ("turnaround_min",))
_silver_query("medication_order", ["medication_order_id", "din", "patient_golden_id", "quantity_ordered", "total_cost", "days_supply", "order_to_dispense_min"], f"select medication_order_id, din2 as din, patient_golden_id, cast(quantity_ordered as decimal(12, 4)) as quantity_ordered, cast(total_cost as decimal(12, 4)) as total_cost, cast(days_supply as int) as days_supply, order_to_dispense_min from {_MED}", ("order_to_dispense_min",))
_MONEY = ("charge_amount", "discount_amount", "tax_amount", "net_amount", "payment_amount", "outstanding_amount")
_silver_query("billing_line", ["invoice_id", "invoice_line_number", "patient_golden_id", "quantity", *_MONEY], f"select invoice_id, invoice_line_number, patient_golden_id, cast(quantity as decimal(12, 2)) as quantity, {', '.join(f'cast({c} as decimal(18, 2)) as {c}' for c in _MONEY)} from {_BILL}")
_SCORES = ("overall_score", "wait_time_score", "staff_courtesy_score", "cleanliness_score", "communication_score", "pain_management_score", "would_recommend_score")
_silver_query("survey_response", ["survey_response_id", "patient_golden_id", *_SCORES, "response_date", "service_date"], f"select survey_response_id, patient_golden_id, {', '.join(f'cast({c} as int) as {c}' for c in _SCORES)}, response_date, service_date from {_SURV} where cast(overall_score as int) between 1 and 10")
_silver_query("facility", ["hospital_id", "hospital_name", "region", "delivery"], f"select hospital_id, hospital_name, region, delivery from {_newest('facility')}")
_silver_query("unit", ["department_id", "department_name", "hospital_id"], f"select department_id, department_name, hospital_id from {_newest('unit')}")


def silver_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    ok, _ = conform.conform(table(spark, d, "diagnosis").withColumn("at", F.col("diagnosis_date")), conform.SPECS["diagnosis"], order=["at", "patient_id"])
    return ok.select("encounter_id", "diagnosis_code", "diagnosis_rank", "diagnosis_date")


_add("silver_diagnosis", silver_diagnosis, "select encounter_id, diagnosis_code, diagnosis_rank::int as diagnosis_rank, max(diagnosis_date) as diagnosis_date from diagnosis group by 1, 2, 3")


def silver_bed_assignment(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "bed_assignment").withColumn("bed_id", plain_id("bed_id"))
    ok, _ = conform.conform(raw, conform.SPECS["bed_assignment"], order=["assignment_end_ts", "assignment_reason", "encounter_id"])
    return ok.select("admission_id", "bed_id", "assignment_start_ts", "assignment_end_ts")


_BA = f"(select admission_id, {_id('bed_id')} as bed_id, assignment_start_ts, max(assignment_end_ts) as assignment_end_ts from bed_assignment where assignment_start_ts is not null group by 1, 2, 3)"
_add("silver_bed_assignment", silver_bed_assignment, f"select * from {_BA}")


def silver_doctor(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "hr_doctor").withColumn("doctor_id", plain_id("doctor_id"))
    ok, _ = conform.conform(raw, conform.SPECS["doctor"], order=["update_ts", "extract_date"])
    return ok.select("doctor_id", "update_ts", "extract_date")


_add("silver_doctor", silver_doctor, f"select doctor_id, max(update_ts) as update_ts, arg_max(extract_date, (update_ts, extract_date)) as extract_date from (select * replace ({_id('doctor_id')} as doctor_id) from hr_doctor) group by 1")


def silver_bed(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "bed_assignment").select(plain_id("bed_id").alias("bed_id"), "assignment_start_ts").filter("bed_id is not null")
    ok, _ = conform.conform(raw, conform.SPECS["bed"], order=["assignment_start_ts"])
    return ok.select("bed_id", F.substring("bed_id", 1, 3).alias("hospital_id"), F.when(F.right("bed_id", F.lit(1)).isin("0", "5"), "ICU").otherwise("MED").alias("ward_type"))


_BEDS = f"(select distinct {_id('bed_id')} as bed_id, left({_id('bed_id')}, 3) as hospital_id, case when right({_id('bed_id')}, 1) in ('0', '5') then 'ICU' else 'MED' end as ward_type from bed_assignment where {_id('bed_id')} is not null)"
_add("silver_bed", silver_bed, f"select * from {_BEDS}")


def silver_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejected rows per entity and reason: every rule at work."""
    parts = [rejected(spark, d, n).select(F.lit(n).alias("entity"), "_dq_reason") for n in ("emergency_visit", "appointment", "lab_result", "survey_response")]
    a = conform.conform(table(spark, d, "admission"), conform.SPECS["admission"], order=["last_modified_ts"])[1]
    b = conform.conform(table(spark, d, "bed_assignment").withColumn("bed_id", plain_id("bed_id")), conform.SPECS["bed_assignment"], order=["assignment_end_ts"])[1]
    parts += [a.select(F.lit("admission").alias("entity"), "_dq_reason"), b.select(F.lit("bed_assignment").alias("entity"), "_dq_reason")]
    return conforming.union_all(parts).groupBy("entity").agg(F.count("*").alias("n"))


_NEW_ADM = "(select * from (select *, row_number() over (partition by admission_id order by last_modified_ts desc) rn from admission) where rn = 1)"
_add("silver_rejects", silver_rejects, f"""select * from (select 'emergency_visit' as entity, count(*) as n from {_ED} where arrival_ts is null union all select 'appointment', count(*) from {_AP} where scheduled_ts is null union all select 'lab_result', count(*) from {_LAB} where turnaround_min < 0
 union all select 'survey_response', count(*) from {_SURV} where not coalesce(cast(overall_score as int) between 1 and 10, false) union all select 'admission', count(*) from {_NEW_ADM} where admission_ts is null
 union all select 'bed_assignment', count(*) from (select distinct admission_id, {_id('bed_id')} from bed_assignment where assignment_start_ts is null)) where n > 0""")

# --- admissions --------------------------------------------------------------------------------


def admissions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "dim_patient").select(F.col("source_patient_id").alias("record_uid"), "patient_golden_id")
    return conform.conform(table(spark, d, "admission"), conform.SPECS["admission"], order=["last_modified_ts"], mapping=feeds.run(spark, d, feeds.MAPPING), xref=x)[0]


def admission_details(spark: SparkSession, d: str) -> DataFrame:
    beds = silver_bed_assignment(spark, d).join(silver_bed(spark, d), "bed_id", "left")
    bills = table(spark, d, "diagnosis").select("encounter_id", (F.col("diagnosis_rank") * F.lit(10)).cast("decimal(18,2)").alias("net_amount"))
    return facts.admission_details(admissions(spark, d), beds, bills, intensive=["ICU"])


_MAP = feeds.plain(feeds.MAPPING)
_STD = lambda c, dom, out: f"coalesce((select standard_code from ({_MAP}) m where m.domain = '{dom}' and m.source_code = upper(trim({c}))), 'UNKNOWN') as {out}"
_ADM = f"""(select *, case when discharge_ts is not null then greatest(date_diff('day', admission_ts, discharge_ts), 1) end::int as length_of_stay_days, {_hours('admission_ts', 'discharge_ts')} as length_of_stay_hours, discharge_ts is null as is_open from
 (select a.* replace (case when discharge_ts >= admission_ts then discharge_ts end as discharge_ts), {_STD('admission_type', 'ADMIT_TYPE', 'admission_type_std')}, {_STD('discharge_disposition_code', 'DISPOSITION', 'disposition_std')}, x.g as patient_golden_id from {_NEW_ADM} a
 left join (select source_patient_id r, min(patient_golden_id) g from dim_patient group by 1) x on x.r = 'EHR|' || a.patient_id where admission_ts is not null))"""
_MOVES = f"""(select admission_id, greatest(count(*) - 1, 0) as transfer_count, coalesce(round(sum(case when ward_type = 'ICU' then (epoch(assignment_end_ts) - epoch(assignment_start_ts)) / 86400.0 end), 6), 0.0)::double as icu_days, arg_min(bed_id, (assignment_start_ts, bed_id)) as first_bed_id
 from {_BA} b left join {_BEDS} using (bed_id) group by 1)"""
_FADM = f"""(select a.*, coalesce(transfer_count, 0)::bigint as transfer_count, coalesce(icu_days, 0.0)::double as icu_days, first_bed_id, coalesce(total_charges, 0.0)::double as total_charges,
  case when patient_golden_id is not null then date_diff('day', pe, admission_ts) end::int as days_since_previous,
  coalesce(patient_golden_id is not null and date_diff('day', pe, admission_ts) between 0 and 30 and admission_type_std <> 'ELECTIVE' and not coalesce(pd in ('TRANSFER', 'DEATH'), false), false) as is_readmission, discharge_ts is not null and disposition_std not in ('TRANSFER', 'DEATH') as is_index
  from (select *, lag(discharge_ts) over w as pe, lag(disposition_std) over w as pd from {_ADM} window w as (partition by patient_golden_id order by admission_ts, admission_id)) a left join {_MOVES} using (admission_id)
  left join (select encounter_id, sum(diagnosis_rank * 10)::double as total_charges from diagnosis group by 1) c using (encounter_id))"""
_ADM_COLS = ["admission_id", "patient_golden_id", "admission_type_std", "disposition_std", "length_of_stay_days", "length_of_stay_hours", "is_open", "transfer_count", "icu_seconds", "first_bed_id", "total_charges", "days_since_previous", "is_readmission", "is_index"]
_add("admission_details", lambda spark, d: _R6(admission_details(spark, d), "length_of_stay_hours").withColumn("icu_seconds", F.round(F.col("icu_days") * 86400).cast("long")).select(*_ADM_COLS), f"select {', '.join(_ADM_COLS)} from (select *, round(icu_days * 86400)::bigint as icu_seconds from {_FADM})")

# --- facts -------------------------------------------------------------------------------------


def _fact(spark: SparkSession, d: str, name: str, source: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    dims = {n: feeds.dim(spark, d, n) for n in feeds.DIMS}
    return facts.build_fact(source, facts.FACTS[name], dims, {n: bk for n, (_, bk, _) in feeds.DIMS.items()}, batch_id="b-1", loaded="2024-01-01 00:00:00", without=without)


_DIM_AT = [("patient_golden_id", "dim_patient", "patient_key"), ("department_id", "dim_department", "department_key")]


def _fact_query(name: str, source: Callable[[SparkSession, str], DataFrame], sql_source: str, ids: list[str], keys: list[str], dates: list[tuple[str, str]], times: list[tuple[str, str]] = (), finish: Callable[[SparkSession, str, DataFrame], DataFrame] | None = None, more: str = "", extra: tuple[str, ...] = ()) -> None:
    cols = [*ids, *[k.rsplit(" as ", 1)[1] for k in keys], *[o for _, o in dates], *[o for _, o in times], *extra]

    def query(spark: SparkSession, d: str) -> DataFrame:
        f = _fact(spark, d, name, source(spark, d))
        return (finish(spark, d, f) if finish else f).select(*cols, "batch_id")

    parts = [*[f"f.{c}" for c in ids], *keys, *[_date_key(c, o) for c, o in dates], *[_time_key(c, o) for c, o in times], *([more] if more else []), "'b-1' as batch_id"]
    _add(name, query, f"select {', '.join(parts)} from {sql_source} f")


_fact_query("fact_emergency_visit", lambda s, d: silver(s, d, "emergency_visit"), f"(select * from {_ED} where arrival_ts is not null)", ["ed_visit_id"],
    [_key("f", "patient_golden_id", "dim_patient", "patient_key", "arrival_ts"), _key("f", "hospital_id", "dim_hospital", "hospital_key", "arrival_ts"), _key("f", "department_id", "dim_department", "department_key", "arrival_ts"), _key("f", "triage_diagnosis_code", "dim_diagnosis", "triage_diagnosis_key", code=True), _key("f", "payer_id", "dim_insurance_provider", "insurance_provider_key")],
    [("arrival_ts", "arrival_date_key"), ("departure_ts", "departure_date_key")], [("arrival_ts", "arrival_time_key")])
_fact_query("fact_appointment", lambda s, d: silver(s, d, "appointment"), f"(select * from {_AP} where scheduled_ts is not null)", ["appointment_id"],
    [_key("f", "patient_golden_id", "dim_patient", "patient_key", "scheduled_ts"), _key("f", "doctor_id", "dim_doctor", "doctor_key", "scheduled_ts"), _key("f", "department_id", "dim_department", "department_key", "scheduled_ts"), _key("f", "hospital_id", "dim_hospital", "hospital_key", "scheduled_ts"), _key("f", "status_code", "dim_appointment_status", "appointment_status_key")],
    [("scheduled_ts", "scheduled_date_key"), ("booking_ts", "booking_date_key")], [("scheduled_ts", "scheduled_time_key")])
_fact_query("fact_lab_result", lambda s, d: silver(s, d, "lab_result"), f"(select * replace (loinc as loinc_code) from {_LAB} where turnaround_min is null or turnaround_min >= 0)", ["placer_order_id", "set_id", "loinc_code", "l_partkey"],
    [_key("f", "patient_golden_id", "dim_patient", "patient_key", "order_ts"), _key("f", "ordering_doctor_id", "dim_doctor", "ordering_doctor_key", "order_ts"), _key("f", "department_id", "dim_department", "department_key", "order_ts"), _key("f", "sending_facility", "dim_hospital", "hospital_key", "order_ts"), _key("f", "loinc_code", "dim_lab_test", "lab_test_key")],
    [("order_ts", "order_date_key"), ("result_ts", "result_date_key")])
_fact_query("fact_medication_order", lambda s, d: silver(s, d, "medication_order"), f"(select * replace (din2 as din) from {_MED})", ["medication_order_id"],
    [_key("f", "patient_golden_id", "dim_patient", "patient_key", "order_ts"), _key("f", "prescribing_doctor_id", "dim_doctor", "prescribing_doctor_key", "order_ts"), _key("f", "department_id", "dim_department", "department_key", "order_ts"), _key("f", "hospital_id", "dim_hospital", "hospital_key", "order_ts"), _key("f", "din", "dim_medication", "medication_key")],
    [("order_ts", "order_date_key"), ("dispense_ts", "dispense_date_key")], [("order_ts", "order_time_key")],
    finish=lambda s, d, f: facts.with_dim_flag(f, feeds.dim(s, d, "dim_medication"), "medication_key", "is_high_alert"), more=f"coalesce((select d.is_high_alert from ({feeds.dim_sql('dim_medication')}) d where d.din = f.din), false) as is_high_alert", extra=("is_high_alert",))
_fact_query("fact_billing_line", lambda s, d: silver(s, d, "billing_line"), _BILL, ["invoice_id", "invoice_line_number"],
    [_key("f", "patient_golden_id", "dim_patient", "patient_key"), _key("f", "department_id", "dim_department", "department_key"), _key("f", "hospital_id", "dim_hospital", "hospital_key"), _key("f", "payer_id", "dim_insurance_provider", "insurance_provider_key")], [])
_fact_query("fact_satisfaction_survey", lambda s, d: silver(s, d, "survey_response"), f"(select * from {_SURV} where cast(overall_score as int) between 1 and 10)", ["survey_response_id", "nps_category"],
    [_key("f", "patient_golden_id", "dim_patient", "patient_key"), _key("f", "doctor_id", "dim_doctor", "doctor_key"), _key("f", "department_id", "dim_department", "department_key"), _key("f", "hospital_id", "dim_hospital", "hospital_key")], [("response_date", "response_date_key"), ("service_date", "service_date_key")])


# the admission fact and the bridge use the shared dimensions of patients and doctors


def _adm_fact(spark: SparkSession, d: str) -> DataFrame:
    src = admission_details(spark, d).withColumn("attending_physician_id", plain_id("attending_physician_id"))
    dims = {n: feeds.dim(spark, d, n) for n in ("dim_admission_type", "dim_discharge_disposition")}
    dims["dim_patient"] = table(spark, d, "dim_patient")
    dims["dim_doctor"] = table(spark, d, "dim_doctor").withColumn("doctor_id", plain_id("doctor_id"))
    dims["dim_diagnosis"] = table(spark, d, "ref_icd10ca").select("diagnosis_code", F.crc32("diagnosis_code").alias("diagnosis_key"))
    bks = {n: feeds.DIMS[n][1] for n in dims}
    return facts.build_fact(src, facts.FACTS["fact_admission"], dims, bks, batch_id="b-1", loaded="2024-01-01 00:00:00", without=("dim_hospital", "dim_department", "dim_insurance_provider"))


_FA_COLS = ["admission_id", "patient_key", "attending_doctor_key", "admission_type_key", "discharge_disposition_key", "has_diagnosis", "admission_date_key", "discharge_date_key", "expected_discharge_date_key", "admission_time_key"]
_add("fact_admission", lambda spark, d: _adm_fact(spark, d).withColumn("has_diagnosis", F.col("primary_diagnosis_key") >= 0).select(*_FA_COLS), f"""
select f.admission_id, coalesce(p.patient_key, -1)::bigint as patient_key, coalesce(t.doctor_key, -1)::bigint as attending_doctor_key, {_key('f', 'admission_type_std', 'dim_admission_type', 'admission_type_key')}, {_key('f', 'disposition_std', 'dim_discharge_disposition', 'discharge_disposition_key')},
 coalesce({_code('f.primary_diagnosis_code')} in (select {_code('diagnosis_code')} from ref_icd10ca), false) as has_diagnosis, {_date_key('f.admission_ts', 'admission_date_key')}, {_date_key('f.discharge_ts', 'discharge_date_key')}, {_date_key('f.expected_discharge_ts', 'expected_discharge_date_key')}, {_time_key('f.admission_ts', 'admission_time_key')}
from {_FADM} f
left join (select a.admission_id, arg_min(p.patient_key, (-epoch_us(p.effective_from_ts), p.patient_key)) as patient_key from {_ADM} a join dim_patient p on p.patient_golden_id = a.patient_golden_id and p.effective_from_ts <= a.admission_ts and a.admission_ts < p.effective_to_ts group by 1) p on p.admission_id = f.admission_id
left join (select a.admission_id, arg_min(t.doctor_key, (-epoch_us(t.effective_from_ts), t.doctor_key)) as doctor_key from {_ADM} a join dim_doctor t on {_id('t.doctor_id')} = {_id('a.attending_physician_id')} and t.effective_from_ts <= a.admission_ts and a.admission_ts < t.effective_to_ts group by 1) t on t.admission_id = f.admission_id""")


def bridge_encounter_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "diagnosis").dropDuplicates()
    x = table(spark, d, "dim_patient").select(F.col("source_patient_id").alias("record_uid"), "patient_golden_id")
    src = conforming.resolve(src, x, [F.concat(F.lit("EHR|"), F.col("patient_id"))], uid="record_uid", golden="patient_golden_id", out="patient_golden_id")
    dims = {"dim_patient": table(spark, d, "dim_patient"), "dim_diagnosis": table(spark, d, "ref_icd10ca").select("diagnosis_code", F.lit(7).alias("diagnosis_key"))}
    f = facts.build_fact(src, facts.FACTS["bridge_encounter_diagnosis"], dims, {n: feeds.DIMS[n][1] for n in dims}, batch_id="b-1", loaded="2024-01-01 00:00:00")
    return f.select("encounter_id", "diagnosis_code", "diagnosis_rank", "patient_key", "diagnosis_key", "diagnosis_date_key")


_add("fact_bed_occupancy_daily", lambda spark, d: _bed_days(spark, d).select("bed_id", "day", "occupied_hours", "available_hours", "blocked_hours", "at_midnight", "turnover_count", "hospital_id"), "")


def _bed_days(spark: SparkSession, d: str) -> DataFrame:
    return facts.bed_occupancy(silver_bed_assignment(spark, d), silver_bed(spark, d), last="2024-03-31", days=60)


_OCC = f"""(with g as (select bed_id, hospital_id, ward_type, d::date as day from {_BEDS}, generate_series(date '2024-02-01', date '2024-03-31', interval 1 day) t(d)),
 h as (select g.*, case when assignment_start_ts is null then 0 else greatest(epoch(least(coalesce(assignment_end_ts, timestamp '2100-01-01'), day + interval 1 day)) - epoch(greatest(assignment_start_ts, day)), 0) end as s, assignment_start_ts <= day and coalesce(assignment_end_ts, timestamp '2100-01-01') > day as mid
  from g left join {_BA} b on b.bed_id = g.bed_id and b.assignment_start_ts < day + interval 1 day and coalesce(b.assignment_end_ts, timestamp '2100-01-01') > day and (b.assignment_end_ts is null or b.assignment_end_ts > b.assignment_start_ts))
 select bed_id, hospital_id, ward_type, day, cast((least(coalesce(sum(s), 0), 86400)::bigint * 100 + 1800) // 3600 / 100 as decimal(6, 2)) as occupied_hours, cast(24 - cast((least(coalesce(sum(s), 0), 86400)::bigint * 100 + 1800) // 3600 / 100 as decimal(6, 2)) as decimal(6, 2)) as available_hours, cast(0 as decimal(6, 2)) as blocked_hours,
  coalesce(max(mid::int), 0) as at_midnight, count(*) filter (where s > 0) as turnover_count from h group by 1, 2, 3, 4)"""
SQL["fact_bed_occupancy_daily"] = f"select bed_id, day, occupied_hours, available_hours, blocked_hours, at_midnight, turnover_count, hospital_id from {_OCC}"
_add("bridge_encounter_diagnosis", bridge_encounter_diagnosis, f"""select f.encounter_id, f.diagnosis_code, f.diagnosis_rank, coalesce(p.k, -1)::bigint as patient_key, case when {_code('f.diagnosis_code')} in (select {_code('diagnosis_code')} from ref_icd10ca) then 7 else -1 end as diagnosis_key, {_date_key('f.diagnosis_date', 'diagnosis_date_key')}
from (select distinct * from diagnosis) f left join (select source_patient_id r, min(patient_golden_id) g from dim_patient group by 1) x on x.r = 'EHR|' || f.patient_id left join (select patient_golden_id g, max(patient_key) k from dim_patient where is_current group by 1) p on p.g = x.g""")

# --- claims ------------------------------------------------------------------------------------


def claims(spark: SparkSession, d: str) -> DataFrame:
    from lamina.plans import catalog
    from lamina.sources import edi

    return edi.claims_with_payment(edi.parse_claims(catalog.claim_files(spark, d)), edi.parse_remittances(catalog.remittance_files(spark, d)))


_CLAIM = """(select 'C' || l_orderkey as claim_number, case when l_orderkey % 11 = 0 then 'CI' else 'PAY' || l_orderkey end as payer_id, 'C' || l_orderkey as patient_source_id, 'H' || (l_orderkey % 27) as hospital_id, 'I110' as primary_diagnosis_code, date '2024-01-02' as service_date, date '2024-01-01' as submission_date,
 case when l_orderkey % 17 = 0 then 0 else n end as line_count, cast(case when l_orderkey % 17 = 0 then 100.00 else 5.50 * n end as decimal(18, 2)) as billed_amount, case when o_orderkey is not null then case o_orderstatus when 'F' then '4' else '1' end end as claim_status_code,
 case when o_orderkey is not null then date '2024-02-03' end as payment_date, cast(case when o_orderkey is not null then 80.00 end as decimal(18, 2)) as paid_amount, cast(case when o_orderkey is not null then 16.50 end as decimal(18, 2)) as adjustment_amount, case when o_orderkey is not null then '45' end as denial_reason_code
 from (select l_orderkey, count(*) n from lineitem group by 1) left join orders on o_orderkey = l_orderkey)"""
_CLAIM2 = f"""(select *, claim_status_code is not null as is_adjudicated, coalesce(claim_status_code in ('1', '2'), false) as is_approved, coalesce(claim_status_code = '4', false) as is_denied, cast(case when claim_status_code = '4' then billed_amount else coalesce(adjustment_amount, 0) end as decimal(18, 2)) as denied_amount,
 date_diff('day', submission_date, payment_date)::int as days_to_payment, cast(case when claim_status_code is not null then billed_amount - case when claim_status_code = '4' then billed_amount else coalesce(adjustment_amount, 0) end end as decimal(18, 2)) as approved_amount from {_CLAIM})"""
_CL_COLS = ["claim_number", "payer_id", "hospital_id", "service_date", "submission_date", "payment_date", "line_count", "billed_amount", "paid_amount", "claim_status_code", "denial_reason_code", "is_adjudicated", "is_approved", "is_denied", "denied_amount", "approved_amount", "days_to_payment"]
_add("silver_claim", lambda spark, d: claims(spark, d).select(*_CL_COLS), f"select {', '.join(_CL_COLS)} from {_CLAIM2}")


def fact_claim(spark: SparkSession, d: str) -> DataFrame:
    c = conforming.resolve(claims(spark, d), xref(spark, d), [F.concat(F.lit("EHR|"), "patient_source_id")], uid="record_uid", golden="patient_golden_id", out="patient_golden_id")
    return _fact(spark, d, "fact_claim", c)


_j, _g = _golden("'EHR|' || s.patient_source_id")
_FC = f"(select s.*, {_g} as patient_golden_id from {_CLAIM2} s {_j})"
_FC_KEYS = [_key("f", "patient_golden_id", "dim_patient", "patient_key"), _key("f", "hospital_id", "dim_hospital", "hospital_key"), _key("f", "payer_id", "dim_insurance_provider", "insurance_provider_key"), _key("f", "claim_status_code", "dim_claim_status", "claim_status_key"), _key("f", "primary_diagnosis_code", "dim_diagnosis", "primary_diagnosis_key", code=True)]
_add("fact_claim", lambda spark, d: fact_claim(spark, d).select("claim_number", "patient_key", "hospital_key", "insurance_provider_key", "claim_status_key", "primary_diagnosis_key", "service_date_key", "submission_date_key", "payment_date_key", "denied_amount", "is_denied"),
    f"select f.claim_number, {', '.join(_FC_KEYS)}, {_date_key('service_date', 'service_date_key')}, {_date_key('submission_date', 'submission_date_key')}, {_date_key('payment_date', 'payment_date_key')}, denied_amount, is_denied from {_FC} f")
_add("remittance_reconciliation", lambda spark, d: _reconciled(spark, d), "select count(*) as remitted, count(*) filter (where l is null) as unmatched, coalesce(round(count(*) filter (where l is null) * 100.0 / count(*), 4), 0)::double as unmatched_pct, count(*) filter (where l is null) * 100.0 / count(*) > 5 as is_warning from (select o_orderkey, (select max(1) from lineitem where l_orderkey = o_orderkey) as l from orders)")
_add("orphan_remittances", lambda spark, d: _unmatched(spark, d), "select 'C' || o_orderkey as claim_number from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from lamina.plans import catalog
    from lamina.sources import edi

    return edi.parse_remittances(catalog.remittance_files(spark, d)), edi.parse_claims(catalog.claim_files(spark, d))


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    from lamina.sources import edi

    return edi.reconcile_remittances(*_both(spark, d))


def _unmatched(spark: SparkSession, d: str) -> DataFrame:
    from lamina.sources import edi

    return edi.unmatched_remittances(*_both(spark, d))


# --- measures ----------------------------------------------------------------------------------

#: measure -> SQL over its fact
_MSQL = {
    "total_admissions": "count(*)", "total_discharges": "count(*) filter (where not is_open)", "open_admissions": "count(*) filter (where is_open)", "average_length_of_stay": "avg(length_of_stay_days)", "median_length_of_stay": "median(length_of_stay_days)", "total_patient_days": "sum(length_of_stay_days)",
    "icu_days": "sum(icu_days)", "readmissions_30d": "count(*) filter (where is_readmission)", "index_admissions": "count(*) filter (where is_index)", "readmission_rate": "count(*) filter (where is_readmission) / nullif(count(*) filter (where is_index), 0)",
    "ed_visits": "count(*)", "median_triage_wait": "median(arrival_to_triage_min)", "median_physician_wait": "median(arrival_to_physician_min)", "p90_ed_length_of_stay": "quantile_cont(ed_length_of_stay_min, 0.9)",
    "ed_target_met": "count(*) filter (where coalesce(ed_length_of_stay_min, 0) <= case when coalesce(ctas_level, 0) <= 2 then 480 else 240 end) / count(*)", "lwbs_rate": "count(*) filter (where left_without_being_seen) / count(*)", "ed_admission_conversion": "count(*) filter (where was_admitted) / count(*)",
    "occupied_bed_hours": "sum(occupied_hours)", "available_bed_hours": "sum(available_hours)", "blocked_bed_hours": "sum(blocked_hours)", "occupancy_rate": "sum(occupied_hours)::double / sum(occupied_hours + available_hours)::double", "midnight_census": "count(*) filter (where at_midnight = 1)", "staffed_beds": "count(distinct bed_id)", "bed_turnover": "sum(turnover_count)",
    "scheduled_appointments": "count(*)", "completed_appointments": "count(*) filter (where is_completed)", "no_shows": "count(*) filter (where is_no_show)", "cancellations": "count(*) filter (where is_cancelled)", "no_show_rate": "count(*) filter (where is_no_show) / nullif(count(*) filter (where is_completed or is_no_show), 0)",
    "cancellation_rate": "count(*) filter (where is_cancelled) / count(*)", "late_cancellation_rate": "count(*) filter (where is_cancelled and coalesce(cancellation_notice_hours, 0) < 24) / count(*)", "average_lead_time": "avg(lead_time_days)", "average_clinic_wait": "avg(wait_minutes)", "distinct_patients_seen": "count(distinct patient_golden_id)",
    "lab_tests": "count(*)", "abnormal_result_rate": "count(*) filter (where is_abnormal) / count(*)", "critical_results": "count(*) filter (where is_critical)", "median_lab_turnaround": "median(turnaround_min)", "stat_turnaround_compliance": "count(*) filter (where turnaround_min <= 60 and priority = 'STAT') / nullif(count(*) filter (where priority = 'STAT'), 0)",
    "medication_orders": "count(*)", "medication_cost": "sum(total_cost)", "high_alert_share": "count(*) filter (where is_high_alert) / count(*)", "median_order_to_dispense": "median(order_to_dispense_min)",
    "claims_submitted": "count(*)", "claims_adjudicated": "count(*) filter (where is_adjudicated)", "claims_approved": "count(*) filter (where is_approved)", "claim_approval_rate": "count(*) filter (where is_approved) / nullif(count(*) filter (where is_adjudicated), 0)", "claim_denial_rate": "count(*) filter (where is_denied) / nullif(count(*) filter (where is_adjudicated), 0)",
    "billed_amount": "sum(billed_amount)", "approved_amount": "sum(approved_amount)", "denied_amount": "sum(denied_amount)", "net_collection_rate": "sum(paid_amount)::double / nullif(sum(approved_amount), 0)::double", "average_days_to_adjudicate": "avg(days_to_payment)", "outstanding_ar": "sum(outstanding_amount)",
    "survey_responses": "count(*)", "average_overall_score": "avg(overall_score)", "net_promoter_score": "100.0 * (count(*) filter (where nps_category = 'PROMOTER') - count(*) filter (where nps_category = 'DETRACTOR')) / count(*)",
    "dq_rules_executed": "count(*)", "dq_pass_rate": "sum(rows_passed)::double / sum(rows_evaluated)::double", "dq_breaches": "count(*) filter (where is_breach)", "critical_dq_breaches": "count(*) filter (where is_breach and severity = 'Error')", "rows_quarantined": "sum(rows_failed)",
}


def _bed_fact(spark: SparkSession, d: str) -> DataFrame:
    return _bed_days(spark, d).withColumn("bed_key", F.col("bed_id"))


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    m = conforming.lookup_current(silver(spark, d, "medication_order"), feeds.dim(spark, d, "dim_medication"), business_key="din", dim_business_key="din", dim_key="medication_key", out="medication_key")
    return facts.with_dim_flag(m, feeds.dim(spark, d, "dim_medication"), "medication_key", "is_high_alert")


_MEDF = f"(select s.* replace (cast(total_cost as decimal(12, 4)) as total_cost), coalesce((select m.is_high_alert from ({feeds.dim_sql('dim_medication')}) m where m.din = s.din2), false) as is_high_alert from {_MED} s)"
_BILLF = "(select * replace (" + ", ".join(f"cast({c} as decimal(18, 2)) as {c}" for c in _MONEY) + f") from {_BILL})"
_SURVF = f"(select * replace (cast(overall_score as int) as overall_score) from {_SURV} where cast(overall_score as int) between 1 and 10)"
#: fact -> (DataFrame, SQL, column the measures are grouped by)
_FACT = {
    "admission": (admission_details, _FADM, "admission_type_std"), "emergency_visit": (lambda s, d: silver(s, d, "emergency_visit"), f"(select * from {_ED} where arrival_ts is not null)", "ctas_level"), "bed_occupancy": (_bed_fact, _OCC, "ward_type"),
    "appointment": (lambda s, d: silver(s, d, "appointment").withColumn("patient_key", F.col("patient_golden_id")), f"(select * from {_AP} where scheduled_ts is not null)", "department_id"), "lab_result": (lambda s, d: silver(s, d, "lab_result"), f"(select * from {_LAB} where turnaround_min is null or turnaround_min >= 0)", "department_id"),
    "medication_order": (_alerts, _MEDF, "department_id"), "claim": (claims, _CLAIM2, "hospital_id"), "billing_line": (lambda s, d: silver(s, d, "billing_line"), _BILLF, "payer_id"), "satisfaction_survey": (lambda s, d: silver(s, d, "survey_response"), _SURVF, "department_id"),
}
_WHOLE = {n for n, q in _MSQL.items() if q.startswith("count(") and "/" not in q}


def _measures_query(fact: str) -> None:
    build, sql, by = _FACT[fact]
    names = [n for n, m in MEASURES.items() if m.fact == fact and n in _MSQL]

    def query(spark: SparkSession, d: str) -> DataFrame:
        m = measures.compute(build(spark, d), names, [by])
        return m.select(by, *[F.col(n).cast("long").alias(n) if n in _WHOLE else F.round(F.col(n).cast("double"), 4).alias(n) for n in names])

    cols = ", ".join(f"({_MSQL[n]})::bigint as {n}" if n in _WHOLE else f"round(({_MSQL[n]})::double, 4) as {n}" for n in names)
    _add(f"measures_{fact}", query, f"select {by}, {cols} from {sql} group by 1")


for _name in _FACT:
    _measures_query(_name)


def measures_dq(spark: SparkSession, d: str) -> DataFrame:
    from lamina.operators import quality

    rules = [quality.Rule("1", "admission_ts IS NOT NULL", severity="Error"), quality.Rule("2", "discharge_ts >= admission_ts", 99.0), quality.Rule("3", "payer_id IS NOT NULL", 100.0, severity="Error")]
    names = [n for n, m in MEASURES.items() if m.fact == "dq_result"]
    m = measures.compute(quality.evaluate(table(spark, d, "admission"), rules), names)
    return m.select(*[F.col(n).cast("long").alias(n) if n != "dq_pass_rate" else F.round(n, 6).alias(n) for n in names])


_add("measures_dq", measures_dq, f"""with r as (select 'Error' as severity, count(*) as rows_evaluated, count(admission_ts) as rows_passed, 100.0 as t from admission union all select 'Warning', count(*), count(*) filter (where discharge_ts >= admission_ts), 99.0 from admission union all select 'Error', count(*), count(payer_id), 100.0 from admission),
 q as (select *, rows_evaluated - rows_passed as rows_failed, rows_passed * 100.0 / rows_evaluated < t as is_breach from r) select {', '.join(f"({_MSQL[n]})::bigint as {n}" if n != 'dq_pass_rate' else f"round({_MSQL[n]}, 6) as {n}" for n in ('dq_rules_executed', 'dq_pass_rate', 'dq_breaches', 'critical_dq_breaches', 'rows_quarantined'))} from q""")


def measures_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Success rate of the runs and hours since the newest one ended."""
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"), F.col("ts").alias("end_ts"))
    return measures.compute(e, ["pipeline_success_rate"]).crossJoin(measures.freshness_hours(e, "2024-03-01 00:00:00")).select(F.round("pipeline_success_rate", 9).alias("pipeline_success_rate"), F.round("freshness_hours", 4).alias("freshness_hours"))  # one row each


_add("measures_pipeline", measures_pipeline, "select round(count(*) filter (where event_type <> 'error') / count(*), 9)::double as pipeline_success_rate, round((epoch(timestamp '2024-03-01') - epoch(date_trunc('second', max(ts)))) / 3600.0, 4)::double as freshness_hours from events")
_add("admissions_per_physician", lambda spark, d: measures.per_distinct(admissions(spark, d), "attending_physician_id", ["hospital_id"]).select("hospital_id", F.round("per_distinct", 6).alias("per_distinct")), f"select hospital_id, round(count(*) / nullif(count(distinct attending_physician_id), 0), 6)::double as per_distinct from {_ADM} group by 1")
_add("occupancy_status", lambda spark, d: measures.compute(_bed_fact(spark, d), ["occupancy_rate"], ["bed_id"]).select("bed_id", measures.occupancy_status(F.col("occupancy_rate")).alias("status")), f"select bed_id, case when r >= 0.95 then 'Critical' when r >= 0.85 then 'High' when r >= 0.65 then 'Target' when r is not null then 'Low' end as status from (select bed_id, {_MSQL['occupancy_rate']} as r from {_OCC} group by 1)")
_add("outstanding_over_90", lambda spark, d: measures.outstanding_over(silver(spark, d, "billing_line"), date="invoice_date", amount="outstanding_amount").select(F.col("outstanding_over").cast("decimal(28,2)").alias("outstanding_over")), f"select cast(sum(outstanding_amount) as decimal(28, 2)) as outstanding_over from {_BILLF} where invoice_date < (select max(invoice_date) from {_BILLF}) - 90")


def survey_response_rate(spark: SparkSession, d: str) -> DataFrame:
    seen = silver(spark, d, "emergency_visit").filter("departure_ts is not null")
    r = measures.response_rate(silver(spark, d, "survey_response"), seen, silver(spark, d, "appointment").filter("is_completed"), "department_id")
    return r.select("department_id", F.round("response_rate", 6).alias("response_rate"))


_add("survey_response_rate", survey_response_rate, f"select department_id, round((select count(*) from {_SURVF} s where s.department_id = u.department_id) / ((select count(*) from {_ED} e where e.department_id = u.department_id and arrival_ts is not null and departure_ts is not null) + (select count(*) from {_AP} p where p.department_id = u.department_id and scheduled_ts is not null and is_completed)), 6)::double as response_rate from (select department_id from {_SURVF} union select department_id from {_ED} where arrival_ts is not null and departure_ts is not null union select department_id from {_AP} where scheduled_ts is not null and is_completed) u")

# --- report shapes and validators --------------------------------------------------------------

_add("no_show_by_lead", lambda spark, d: measures.no_show_by_lead(silver(spark, d, "appointment")).withColumn("no_show_rate", F.round("no_show_rate", 6)), f"select case when lead_time_days <= 7 then '0-7' when lead_time_days <= 14 then '8-14' when lead_time_days <= 29 then '15-29' when lead_time_days is not null then '30+' end as lead_band, count(*) filter (where is_completed) as completed_appointments, count(*) filter (where is_no_show) as no_shows, round({_MSQL['no_show_rate']}, 6)::double as no_show_rate from {_AP} where scheduled_ts is not null group by 1")
_add("repeat_no_shows", lambda spark, d: measures.repeat_cohort(silver(spark, d, "appointment"), "patient_ref", F.col("is_no_show")), f"select patient_ref, count(*) as times from {_AP} where scheduled_ts is not null and is_no_show group by 1 having count(*) >= 2")
_add("receivables_ageing", lambda spark, d: measures.ageing(silver(spark, d, "billing_line"), date="invoice_date", amount="outstanding_amount", by=["payer_id"]).withColumn("outstanding", F.col("outstanding").cast("decimal(28,2)")), f"select payer_id, case when n <= 30 then '0-30' when n <= 60 then '31-60' when n <= 90 then '61-90' else 'over 90' end as age_band, cast(sum(outstanding_amount) as decimal(28, 2)) as outstanding, count(*) as lines from (select *, date_diff('day', invoice_date, (select max(invoice_date) from {_BILLF})) as n from {_BILLF}) where outstanding_amount > 0 group by 1, 2")


def period_over_period(spark: SparkSession, d: str) -> DataFrame:
    a = admissions(spark, d).withColumn("month", F.date_format("admission_ts", "yyyy-MM"))
    m = measures.compute(a, ["total_admissions", "total_patient_days"], ["hospital_id", "month"])
    return measures.period_over_period(m, "month", ["total_admissions", "total_patient_days"], ["hospital_id"])


_add("period_over_period", period_over_period, f"with m as (select hospital_id, strftime(admission_ts, '%Y-%m') as month, count(*) as total_admissions, sum(length_of_stay_days)::bigint as total_patient_days from {_ADM} group by 1, 2) select *, lag(total_admissions) over w as previous_total_admissions, lag(total_patient_days) over w as previous_total_patient_days, total_admissions - lag(total_admissions) over w as total_admissions_change, total_patient_days - lag(total_patient_days) over w as total_patient_days_change from m window w as (partition by hospital_id order by month)")
_STEPS = {"admitted": "true", "discharged": "NOT is_open", "home": "disposition_std = 'HOME'"}
_add("disposition_funnel", lambda spark, d: measures.funnel(admissions(spark, d), _STEPS).withColumn("of_previous", F.round("of_previous", 6)), f"with n as (select count(*) a, count(*) filter (where not is_open) b, count(*) filter (where not is_open and disposition_std = 'HOME') c from {_ADM}) select 0::int as step_no, 'admitted' as step, a as n, 1.0::double as of_previous from n union all select 1, 'discharged', b, round(b / a, 6) from n union all select 2, 'home', c, round(c / b, 6) from n")
_add("physician_wait_by_level", lambda spark, d: measures.monotone(measures.compute(silver(spark, d, "emergency_visit").filter("ctas_level is not null"), ["median_physician_wait"], ["ctas_level"]), "ctas_level", "median_physician_wait"), f"select ctas_level, m as median_physician_wait, coalesce(m >= lag(m) over (order by ctas_level), true) as rises from (select ctas_level, median(arrival_to_physician_min) as m from {_ED} where arrival_ts is not null and ctas_level is not null group by 1)")


def lead_ratio(spark: SparkSession, d: str) -> DataFrame:
    """No-show rate of late bookings over that of early ones, and whether it is more than 1.15."""
    a = silver(spark, d, "appointment").filter("is_completed or is_no_show")
    rate = lambda c: F.try_divide(F.count_if(c & F.col("is_no_show")).cast("double"), F.count_if(c))
    r = a.agg(rate(F.col("lead_time_days") <= 7).alias("short"), rate(F.col("lead_time_days") >= 30).alias("long"))
    return r.select(F.round(F.try_divide("long", "short"), 6).alias("ratio"), (F.try_divide("long", "short") > 1.15).alias("holds"))


_add("lead_ratio", lead_ratio, f"select round(b / a, 6)::double as ratio, b / a > 1.15 as holds from (select count(*) filter (where is_no_show and lead_time_days <= 7) / count(*) filter (where lead_time_days <= 7) a, count(*) filter (where is_no_show and lead_time_days >= 30) / count(*) filter (where lead_time_days >= 30) b from {_AP} where scheduled_ts is not null and (is_completed or is_no_show))")
_add("denial_spread", lambda spark, d: _R6(measures.rate_spread(claims(spark, d), "hospital_id", F.col("is_denied"), F.col("is_adjudicated")).withColumns({c: F.col(c).cast("double") for c in ("pct", "spread")}), "pct", "spread"), f"with g as (select hospital_id, count(*) as n, count(*) filter (where is_denied) * 100.0 / count(*) as pct from {_CLAIM2} where is_adjudicated group by 1 having count(*) >= 20) select hospital_id, n, round(pct, 6)::double as pct, round((select max(pct) - min(pct) from g), 6)::double as spread from g")
_add("overall_occupancy", lambda spark, d: silver_bed_assignment(spark, d).filter("assignment_end_ts > assignment_start_ts").agg(F.round(F.sum(F.unix_seconds("assignment_end_ts") - F.unix_seconds("assignment_start_ts")) / 86400.0 / (F.count_distinct("bed_id") * 731), 6).alias("occupancy")), f"select round(sum(epoch(assignment_end_ts) - epoch(assignment_start_ts)) / 86400.0 / (count(distinct bed_id) * 731), 6)::double as occupancy from {_BA} where assignment_end_ts > assignment_start_ts")


def satisfaction_by_wait(spark: SparkSession, d: str) -> DataFrame:
    """Mean overall score per third of the emergency waits, joined by encounter."""
    from pyspark.sql import Window

    w = silver(spark, d, "emergency_visit").filter("arrival_to_physician_min is not null").join(silver(spark, d, "survey_response").select("encounter_id", "overall_score"), "encounter_id")
    # thirds by the cuts of the distribution, not by a window over all rows
    cut = w.agg(F.percentile("arrival_to_physician_min", 1 / 3).alias("a"), F.percentile("arrival_to_physician_min", 2 / 3).alias("b"))
    third = F.when(F.col("arrival_to_physician_min") <= F.col("a"), 1).when(F.col("arrival_to_physician_min") <= F.col("b"), 2).otherwise(3)
    return w.crossJoin(F.broadcast(cut)).groupBy(third.alias("third")).agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 6).alias("mean_score"))  # one row


_add("satisfaction_by_wait", satisfaction_by_wait, f"with w as (select arrival_to_physician_min as m, cast(s.overall_score as int) as o from {_ED} e join {_SURVF} s using (encounter_id) where arrival_ts is not null and arrival_to_physician_min is not null), c as (select quantile_cont(m, 1.0 / 3) a, quantile_cont(m, 2.0 / 3) b from w) select (case when m <= a then 1 when m <= b then 2 else 3 end)::int as third, count(*) as n, round(avg(o), 6)::double as mean_score from w, c group by 1")
_add("panel_size", lambda spark, d: measures.compute(silver(spark, d, "appointment").withColumn("patient_key", F.col("patient_golden_id")).filter("is_completed"), ["distinct_patients_seen", "completed_appointments"], ["doctor_id"]), f"select doctor_id, count(distinct patient_golden_id) as distinct_patients_seen, count(*) as completed_appointments from {_AP} where scheduled_ts is not null and is_completed group by 1")


def medication_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Cost per class of drug and its share of orders on the formulary, which is what the dimension knows."""
    m = _alerts(spark, d).withColumn("drug_class", F.substring("din", 1, 2))
    return m.groupBy("drug_class").agg(F.sum("total_cost").cast("decimal(22,4)").alias("cost"), F.round(F.avg((F.col("medication_key") >= 0).cast("double")), 6).alias("formulary_share"))


_add("medication_by_class", medication_by_class, f"select left(din2, 2) as drug_class, cast(sum(total_cost) as decimal(22, 4)) as cost, round(count(*) filter (where din2 in (select din from ({feeds.dim_sql('dim_medication')}))) / count(*), 6)::double as formulary_share from {_MEDF} group by 1")


def failing_rules(spark: SparkSession, d: str) -> DataFrame:
    """Pass rate per severity and the rule that fails most rows in each."""
    from lamina.operators import quality

    rules = [quality.Rule("1", "discharge_ts >= admission_ts", severity="Error"), quality.Rule("2", "payer_id IS NOT NULL", severity="Error"), quality.Rule("3", "department_id IS NOT NULL"), quality.Rule("4", "discharge_disposition_code IS NOT NULL")]
    r = quality.evaluate(table(spark, d, "admission"), rules)
    return r.groupBy("severity").agg(F.round(F.sum("rows_passed") * 100.0 / F.sum("rows_evaluated"), 4).cast("double").alias("pass_rate"), F.max(F.struct("rows_failed", "rule_id"))["rule_id"].alias("worst"))


_add("failing_rules", failing_rules, "with r as (select 'Error' as severity, '1' as rule_id, count(*) n, count(*) filter (where discharge_ts >= admission_ts) p from admission union all select 'Error', '2', count(*), count(payer_id) from admission union all select 'Warning', '3', count(*), count(department_id) from admission union all select 'Warning', '4', count(*), count(discharge_disposition_code) from admission) select severity, round(sum(p) * 100.0 / sum(n), 4)::double as pass_rate, arg_max(rule_id, (n - p, rule_id)) as worst from r group by 1")
