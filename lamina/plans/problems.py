"""Queries of the general data problems 1, 2, 6 and 7 on the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.spelling import BLANKS, plain_code, plain_flag, plain_id, plain_number, plain_word
from lamina.operators.asof import as_of, latest_rows
from lamina.operators.history import snapshot, version_history
from lamina.operators.intervals import spans
from lamina.operators.orphans import missing_references, orphan_report
from lamina.session import table, written

TS = "yyyy-MM-dd HH:mm:ss"
DOCTOR_ATTRS = ("primary_department_id", "specialty", "sub_specialty", "employment_type", "fte", "is_active")


def _doctor_payload() -> Column:
    parts = [plain_number(c) if c == "fte" else plain_flag(c) if c == "is_active" else plain_word(c) for c in DOCTOR_ATTRS]
    return F.concat_ws("\x1f", *parts)


def entity_versions(spark: SparkSession, d: str) -> DataFrame:
    """Version histories of doctors (loaded dimension, then extracts) and of mastered patients."""
    dim, hr, pat = (table(spark, d, t) for t in ("dim_doctor", "hr_doctor", "dim_patient"))
    high = F.lit("9999-12-31").cast("timestamp")
    return version_history(
        [
            snapshot(dim, "doctor", plain_id("doctor_id"), F.col("effective_from_ts"), _doctor_payload(), F.when(F.col("effective_to_ts") < high, F.col("effective_to_ts"))),
            snapshot(hr, "doctor", plain_id("doctor_id"), F.col("update_ts"), _doctor_payload(), rank=1),
            snapshot(pat, "patient", F.col("patient_golden_id"), F.col("effective_from_ts"), F.lower("row_hash")),
        ]
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    v = entity_versions(spark, d)
    return v.select("entity_name", "entity_id", F.date_format("valid_from", TS).alias("valid_from"), F.date_format("valid_to", TS).alias("valid_to"))


def p1_version_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many entities have how many versions."""
    n = entity_versions(spark, d).groupBy("entity_name", "entity_id").agg(F.count("*").alias("versions"))
    return n.groupBy("entity_name", "versions").agg(F.count("*").alias("entities"))


def _admissions(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    """The row that counts of each admission."""
    a = table(spark, d, "admission").filter("admission_id is not null")
    return latest_rows(a, F.col("admission_id"), "last_modified_ts", keep, "admission_id")


_DOCTOR_TAKE = ["doctor_key", "primary_department_id", "specialty", "sub_specialty", "employment_type", "fte", "is_active"]


def _attended(spark: SparkSession, d: str, take: list[str]) -> DataFrame:
    return as_of(
        _admissions(spark, d, ["attending_physician_id", "admission_ts"]),
        table(spark, d, "dim_doctor"),
        event_id=["admission_id"], event_entity=plain_id("attending_physician_id"), event_at="admission_ts",
        version_entity=plain_id("doctor_id"), valid_from="effective_from_ts", valid_to="effective_to_ts", take=take,
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _attended(spark, d, ["doctor_key"])


def p2_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every admission with the attributes of its physician at admission time."""
    return _attended(spark, d, _DOCTOR_TAKE)


def _bed_spans(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bed_assignment")
    return spans(b, entity=plain_id("bed_id"), start=F.col("assignment_start_ts"), end=F.col("assignment_end_ts"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _bed_spans(spark, d).select(F.col("entity").alias("bed_id"), "span_kind", F.date_format("start_ts", TS).alias("start_ts"), F.date_format("end_ts", TS).alias("end_ts"))


def p6_bed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per bed: number and hours of periods (those that have ended) and gaps."""
    s = _bed_spans(spark, d).filter(F.col("end_ts") < F.lit("9999-12-31").cast("timestamp"))
    secs = (F.unix_seconds("end_ts") - F.unix_seconds("start_ts")).alias("secs")
    t = s.select(F.col("entity").alias("bed_id"), "span_kind", secs)
    return t.groupBy("bed_id", "span_kind").agg(F.count("*").alias("spans"), F.sum("secs").alias("span_seconds"))


def _admission_orphans(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, Column]]:
    a = _admissions(spark, d, ["primary_diagnosis_code", "attending_physician_id", "admission_ts"])
    a = written(a.select("admission_id", "admission_ts", plain_code("primary_diagnosis_code").alias("code"), plain_id("attending_physician_id").alias("doctor")))
    keep = ["admission_id", "admission_ts"]
    codes = missing_references(a, table(spark, d, "ref_icd10ca"), ref_key=F.col("code"), parent_key=plain_code("diagnosis_code"), keep=keep)
    doctors = missing_references(a, table(spark, d, "dim_doctor"), ref_key=F.col("doctor"), parent_key=plain_id("doctor_id"), keep=keep)
    return [("admission.primary_diagnosis_code", codes, F.col("admission_ts")), ("admission.attending_physician_id", doctors, F.col("admission_ts"))]


def _encounter_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Missing encounters of diagnoses, one row per encounter and month, with the number of rows."""
    g = table(spark, d, "diagnosis").groupBy(plain_id("encounter_id").alias("enc"), F.date_format("diagnosis_date", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))
    return missing_references(g, table(spark, d, "admission"), ref_key=F.col("enc"), parent_key=plain_id("encounter_id"), keep=["period", "n"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    (f1, codes, _), (f2, doctors, _) = _admission_orphans(spark, d)
    row = lambda df, f, k: df.select(F.lit(f).alias("ref_field"), F.col(k).alias("record_key"))
    enc = _encounter_orphans(spark, d).select("ref_key").distinct()
    return row(codes, f1, "admission_id").unionByName(row(doctors, f2, "admission_id")).unionByName(row(enc, "diagnosis.encounter_id", "ref_key"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table field and month."""
    parts = [orphan_report(m, ref_field=f, period=at) for f, m, at in _admission_orphans(spark, d)]
    enc = _encounter_orphans(spark, d).groupBy(F.lit("diagnosis.encounter_id").alias("ref_field"), "period").agg(F.sum("n").alias("orphan_rows"), F.count_distinct("ref_key").alias("orphan_keys"))
    return parts[0].unionByName(parts[1]).unionByName(enc)


QUERIES = {f.__name__: f for f in (p1_found, p1_version_counts, p2_found, p2_attributes, p6_found, p6_bed_totals, p7_found, p7_report)}

# --- the same in SQL -----------------------------------------------------------------------------


def _id(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^{BLANKS}+|{BLANKS}+$', '', 'g')), '')"


def _code(c: str) -> str:
    return f"case when {_id(c)} is not null then upper(regexp_replace({c}, '{BLANKS}|[.]', '', 'g')) end"


def _word(c: str) -> str:
    return f"coalesce(upper(trim(regexp_replace(cast({c} as varchar), '{BLANKS}+', ' ', 'g'))), '')"


def _flag(c: str) -> str:
    return f"case when {_word(c)} in ('1', 'Y', 'YES', 'T', 'TRUE') then '1' when {_word(c)} in ('0', 'N', 'NO', 'F', 'FALSE') then '0' else {_word(c)} end"


def _number(c: str) -> str:
    return f"coalesce(cast(try_cast({_word(c)} as decimal(20, 4)) as varchar), {_word(c)})"


_PAYLOAD = "concat_ws('|', " + ", ".join(_number(c) if c == "fte" else _flag(c) if c == "is_active" else _word(c) for c in DOCTOR_ATTRS) + ")"
_HIGH = "timestamp '9999-12-31'"
_VERSIONS = f"""
with raw as (
  select 'doctor' n, {_id("doctor_id")} e, effective_from_ts t, {_PAYLOAD} p, nullif(effective_to_ts, {_HIGH}) x, 0 k from dim_doctor
  union all select 'doctor', {_id("doctor_id")}, update_ts, {_PAYLOAD}, null, 1 from hr_doctor
  union all select 'patient', patient_golden_id, effective_from_ts, lower(row_hash), null, 0 from dim_patient
), one as (
  select n, e, t, max_by(p, (k, p)) p, max(x) x from raw where e is not null and t is not null group by n, e, t
), run as (
  select *, sum(case when p is distinct from q then 1 else 0 end) over (partition by n, e order by t) g
  from (select *, lag(p) over (partition by n, e order by t) q from one)
), ver as (
  select n, e, g, min(t) f, max_by(x, t) filter (where x is not null) x from run group by n, e, g
), v as (
  select n entity_name, e entity_id, f valid_from,
    least(coalesce(lead(f) over (partition by n, e order by f), {_HIGH}), coalesce(x, {_HIGH})) valid_to from ver
)"""
_ADM = "adm as (select * from (select *, row_number() over (partition by admission_id order by last_modified_ts desc) rn from admission where admission_id is not null) where rn = 1)"
_AT = f"with {_ADM} select a.admission_id, d.* from adm a join (select distinct doctor_key, {_id('doctor_id')} did, effective_from_ts f, effective_to_ts t, COLS from dim_doctor) d on d.did = {_id('a.attending_physician_id')} and d.f <= a.admission_ts and a.admission_ts < d.t"
_SPANS = f"""
with r as (
  select {_id("bed_id")} b, assignment_start_ts s, coalesce(assignment_end_ts, {_HIGH}) e from bed_assignment
  where {_id("bed_id")} is not null and assignment_start_ts is not null and coalesce(assignment_end_ts, {_HIGH}) > assignment_start_ts
), m as (
  select *, max(e) over (partition by b order by s, e rows between unbounded preceding and 1 preceding) pe from r
), g as (
  select b, s, e, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by b order by s, e rows unbounded preceding) k from m
), per as (select b, k, min(s) s, max(e) e from g group by b, k
), sp as (
  select b, 'period' kind, s, e from per
  union all select b, 'gap', e, n from (select b, e, lead(s) over (partition by b order by s) n from per) where n is not null
)"""
_MISS = f"""
with {_ADM}, m as (
  select 'admission.primary_diagnosis_code' f, admission_id k, {_code("primary_diagnosis_code")} r, admission_ts::date t from adm
    where {_code("primary_diagnosis_code")} not in (select {_code("diagnosis_code")} from ref_icd10ca where {_code("diagnosis_code")} is not null)
  union all select 'admission.attending_physician_id', admission_id, {_id("attending_physician_id")}, admission_ts::date from adm
    where {_id("attending_physician_id")} not in (select {_id("doctor_id")} from dim_doctor where {_id("doctor_id")} is not null)
  union all select 'diagnosis.encounter_id', {_id("encounter_id")}, {_id("encounter_id")}, diagnosis_date from diagnosis
    where {_id("encounter_id")} not in (select {_id("encounter_id")} from admission where {_id("encounter_id")} is not null)
)"""
_FMT = "'%Y-%m-%d %H:%M:%S'"

SQL = {
    "p1_found": f"{_VERSIONS} select entity_name, entity_id, strftime(valid_from, {_FMT}) valid_from, strftime(valid_to, {_FMT}) valid_to from v",
    "p1_version_counts": f"{_VERSIONS} select entity_name, versions, count(*) entities from (select entity_name, entity_id, count(*) versions from v group by all) group by all",
    "p2_found": f"select admission_id, doctor_key from ({_AT.replace('COLS', '1 as one')})",
    "p2_attributes": f"select admission_id, {', '.join(_DOCTOR_TAKE)} from ({_AT.replace('COLS', ', '.join(_DOCTOR_TAKE[1:]))})",
    "p6_found": f"{_SPANS} select b bed_id, kind span_kind, strftime(s, {_FMT}) start_ts, strftime(e, {_FMT}) end_ts from sp",
    "p6_bed_totals": f"{_SPANS} select b bed_id, kind span_kind, count(*) spans, cast(sum(epoch(e) - epoch(s)) as bigint) span_seconds from sp where e < {_HIGH} group by all",
    "p7_found": f"{_MISS} select distinct f ref_field, k record_key from m",
    "p7_report": f"{_MISS} select f ref_field, strftime(t, '%Y-%m') period, count(*) orphan_rows, count(distinct r) orphan_keys from m group by all",
}
