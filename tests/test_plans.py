from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lamina.operators import access, occupancy
from lamina.plans import conform, dims, facts, measures, registry
from lamina.plans.measures import Measure

T = datetime


def test_calendar_and_minutes(spark):
    c = {r.date_key: r for r in dims.calendar(spark, "2024-03-30", "2024-04-02").collect()}
    assert (c[20240331].fiscal_year, c[20240331].fiscal_period, c[20240401].fiscal_year, c[20240401].fiscal_period, c[20240331].day_of_week, c[20240331].is_weekend) == (2023, 12, 2024, 1, 1, True)
    assert c[20240331].week_start == date(2024, 3, 25) and -1 in c
    m = {r.time_key: r for r in dims.minutes(spark).collect()}
    assert len(m) == 1441 and (m[0].shift_name, m[420].shift_name, m[905].clock, m[1380].shift_name) == ("Night", "Day", "15:05", "Night")


def test_load_dim_twice(spark):
    d = dims.DIMS["dim_bed"]
    src = spark.createDataFrame([("b1", "W", "ICU", "x", "d1", "1")], "bed_id string, ward_name string, ward_type string, bed_type string, department_id string, is_active string")
    one = dims.load_dim(d, None, src, run_ts="2024-01-01 00:00:00")
    two = dims.load_dim(d, one, src, run_ts="2024-01-02 00:00:00")
    assert rows(one, "bed_key", "bed_id") == rows(two, "bed_key", "bed_id") and one.count() == 4
    s = dims.static_dim(spark, [("A", "x"), ("B", "y")], "status_code string, label string", dims.DIMS["dim_appointment_status"])
    assert rows(s.filter("appointment_status_key > 0"), "status_code") == [("A",), ("B",)]


def test_readmission_exclusions(spark):
    ddl = "k int, p string, a date, d date, planned boolean, away boolean"
    D = lambda m, n: date(2024, m, n)
    data = [
        (1, "p", D(1, 1), D(1, 5), False, False), (2, "p", D(1, 20), D(1, 22), False, False), (3, "p", D(4, 1), D(4, 2), False, False), (4, "p", D(4, 10), D(4, 12), True, False),
        (5, "q", D(1, 1), D(1, 2), False, True), (6, "q", D(1, 5), D(1, 6), False, False), (7, None, D(1, 1), D(1, 2), False, False), (8, None, D(1, 3), D(1, 4), False, False),
        (9, "r", D(1, 1), None, False, False), (10, "r", D(1, 3), None, False, False),
    ]
    r = occupancy.readmissions(spark.createDataFrame(data, ddl), person="p", start="a", end="d", key="k", planned=F.col("planned"), ended_elsewhere=F.col("away"))
    assert [x.k for x in r.filter("is_readmission").collect()] == [2]
    assert sorted(x.k for x in r.filter("is_index").collect()) == [1, 2, 3, 4, 6, 7, 8]


def test_occupancy_grid(spark):
    s = spark.createDataFrame([("b", T(2024, 1, 1, 12), T(2024, 1, 3, 6)), ("b", T(2024, 1, 3, 5), T(2024, 1, 3, 8)), ("c", T(2023, 1, 1), None), (None, T(2024, 1, 1), None), ("b", T(2024, 1, 2), T(2024, 1, 2))], "u string, s timestamp, e timestamp")
    units = spark.createDataFrame([("b",), ("c",), ("idle",)], "u string")
    g = {(r.u, r.day.day): (r.occupied_hours, r.at_midnight, r.stays) for r in occupancy.daily_occupancy(s, unit="u", start="s", end="e", first="2024-01-01", last="2024-01-04", units=units).collect()}
    assert len(g) == 12 and g["b", 1] == (12.0, 0, 1) and g["b", 2] == (24.0, 1, 1) and g["b", 3] == (9.0, 1, 2) and g["b", 4] == (0.0, 0, 0)
    assert g["c", 4] == (24.0, 1, 1) and g["idle", 2] == (0.0, 0, 0)


def test_census(spark):
    s = spark.createDataFrame([(T(2024, 1, 1), T(2024, 1, 3)), (T(2024, 1, 2), None), (None, T(2024, 1, 1))], "s timestamp, e timestamp")
    d = spark.createDataFrame([(date(2023, 12, 31),), (date(2024, 1, 1),), (date(2024, 1, 2),), (date(2024, 1, 3),)], "day date")
    assert [r.census for r in occupancy.census(s, start="s", end="e", days=d).orderBy("day").collect()] == [0, 1, 2, 1]


def test_conform_admission_and_survey(spark):
    raw = spark.createDataFrame([("a", "p1", "2024-01-05 08:00:00", "2024-01-02 08:00:00", "EMERG", "HOME", "1"), ("a", "p1", "2024-01-05 08:00:00", "2024-01-08 08:00:00", "EMERG", "HOME", "2"), ("b", "p9", None, None, "??", None, "1")], "admission_id string, patient_id string, admission_ts string, discharge_ts string, admission_type string, discharge_disposition_code string, _ingest_ts string")
    m = spark.createDataFrame([("ADMIT_TYPE", "EHR", "EMERG", "EMERGENCY", "true"), ("DISPOSITION", "EHR", "HOME", "HOME", "true")], "domain string, source_system string, source_code string, standard_code string, is_active string")
    x = spark.createDataFrame([("EHR|p1", "g1")], "record_uid string, patient_golden_id string")
    ok, bad = conform.conform(raw, conform.SPECS["admission"], order=["_ingest_ts"], mapping=m, xref=x)
    (r,) = ok.collect()
    assert (r.admission_type_std, r.disposition_std, r.patient_golden_id, r.length_of_stay_days, r.is_open) == ("EMERGENCY", "HOME", "g1", 3, False)
    assert rows(bad, "admission_id") == [("b",)]
    sv = spark.createDataFrame([("1", "11"), ("2", "9"), ("3", None)], "survey_response_id string, overall_score string")
    ok, bad = conform.conform(sv, conform.SPECS["survey_response"], order=["survey_response_id"])
    assert rows(ok, "survey_response_id") == [("2",)] and bad.count() == 2


@pytest.mark.parametrize("name", sorted(conform.SPECS))
def test_every_entity_conforms(spark, name):
    s = conform.SPECS[name]
    extra = {"admission": ["patient_id", "admission_type", "discharge_disposition_code"], "emergency_visit": ["triage_score", "resulted_in_admission", "patient_id"], "appointment": ["status_code", "patient_ref"], "lab_result": ["abnormal_flag", "patient_id"], "medication_order": ["din", "patient_id"]}.get(name, [])
    cols = list(dict.fromkeys([*s.keys, *s.casts, *extra, "_ingest_ts"]))
    raw = spark.createDataFrame([tuple("2024-01-01 00:00:00" if c.endswith("_ts") else "1" for c in cols)] * 2 + [tuple([None] * len(cols))], ", ".join(f"{c} string" for c in cols))
    ok, bad = conform.conform(raw, s, order=["_ingest_ts"])
    assert ok.count() + bad.count() == 2


def test_facts(spark):
    adm = spark.createDataFrame([("a1", "e1", "g1", "d1", T(2024, 1, 1), T(2024, 1, 5), "EMERGENCY", "HOME", "i10.4")], "admission_id string, encounter_id string, patient_golden_id string, attending_physician_id string, admission_ts timestamp, discharge_ts timestamp, admission_type_std string, disposition_std string, primary_diagnosis_code string")
    beds = spark.createDataFrame([("a1", "b2", "ICU", T(2024, 1, 2), T(2024, 1, 4)), ("a1", "b1", "MED", T(2024, 1, 1), T(2024, 1, 2))], "admission_id string, bed_id string, ward_type string, assignment_start_ts timestamp, assignment_end_ts timestamp")
    ch = spark.createDataFrame([("e1", 5.0), ("e1", 7.5)], "encounter_id string, net_amount double")
    f = facts.admission_details(adm, beds, ch, intensive=["ICU"]).first()
    assert (f.transfer_count, f.icu_days, f.first_bed_id, f.total_charges, f.is_index, f.is_readmission) == (1, 2.0, "b1", 12.5, True, False)
    doc = spark.createDataFrame([(1, "d1", T(2020, 1, 1), T(2023, 1, 1), False), (2, "d1", T(2023, 1, 1), T(9999, 12, 31), True)], "doctor_key int, doctor_id string, effective_from_ts timestamp, effective_to_ts timestamp, is_current boolean")
    dia = spark.createDataFrame([(8, "I104")], "diagnosis_key int, diagnosis_code string")
    rest = ["dim_patient", "dim_hospital", "dim_department", "dim_admission_type", "dim_discharge_disposition", "dim_insurance_provider"]
    adm = adm.withColumn("expected_discharge_ts", F.lit(None).cast("timestamp"))
    kw = {"batch_id": "b", "loaded": "2024-02-01 00:00:00"}
    got = facts.build_fact(adm, facts.FACTS["fact_admission"], {"dim_doctor": doc, "dim_diagnosis": dia}, {"dim_doctor": "doctor_id", "dim_diagnosis": "diagnosis_code"}, without=rest, **kw).first()
    with pytest.raises(KeyError, match="dim_patient"):  # nothing is left out silently
        facts.build_fact(adm, facts.FACTS["fact_admission"], {"dim_doctor": doc, "dim_diagnosis": dia}, {"dim_doctor": "doctor_id", "dim_diagnosis": "diagnosis_code"}, **kw)
    with pytest.raises(KeyError, match="discharge_ts"):
        facts.build_fact(adm.drop("discharge_ts"), facts.FACTS["fact_admission"], {"dim_doctor": doc, "dim_diagnosis": dia}, {"dim_doctor": "doctor_id", "dim_diagnosis": "diagnosis_code"}, without=rest, **kw)
    med = facts.with_dim_flag(spark.createDataFrame([(1, 5), (2, -1)], "o int, medication_key int"), spark.createDataFrame([(5, True), (5, False), (6, True)], "medication_key int, is_high_alert boolean"), "medication_key", "is_high_alert")
    assert rows(med, "o", "is_high_alert") == [(1, True), (2, False)]
    assert (got.attending_doctor_key, got.primary_diagnosis_key, got.admission_date_key, got.admission_time_key, got.batch_id) == (2, 8, 20240101, 0, "b")
    b = facts.bed_occupancy(beds, spark.createDataFrame([("b1", "d"), ("b9", "d")], "bed_id string, department_id string"), last="2024-01-03", days=3)
    assert b.count() == 6 and float(b.filter("bed_id = 'b1' and day = '2024-01-01'").first().available_hours) == 0.0
    assert len(facts.FACTS) == 10


def test_measures(spark):
    e = spark.createDataFrame([(500, None), (None, 5), (200, 4), (470, 2)], "ed_length_of_stay_min int, ctas_level int")
    r = measures.compute(e, ["ed_visits", "ed_target_met", "p90_ed_length_of_stay"]).first()
    assert r.ed_visits == 4 and r.ed_target_met == 0.75 and abs(r.p90_ed_length_of_stay - 494) < 1e-9
    a = spark.createDataFrame([(True, False), (False, True), (True, True)], "is_completed boolean, is_no_show boolean").withColumn("is_completed", F.col("is_completed") & ~F.col("is_no_show"))
    assert measures.compute(a, ["no_show_rate"]).first()[0] == 2 / 3
    assert measures.compute(a.limit(0), ["no_show_rate"]).first()[0] is None
    b = spark.createDataFrame([(20.0, 4.0, 0.0), (10.0, 14.0, 0.0)], "occupied_hours double, available_hours double, blocked_hours double")
    assert measures.compute(b, ["occupancy_rate"]).first()[0] == 30 / 48
    st = spark.createDataFrame([(0.96,), (0.9,), (0.7,), (0.1,), (None,)], "r double").select(measures.occupancy_status(F.col("r")).alias("s"))
    assert [x.s for x in st.collect()] == ["Critical", "High", "Target", "Low", None]
    nps = spark.createDataFrame([("PROMOTER",), ("PROMOTER",), ("DETRACTOR",), ("PASSIVE",)], "nps_category string")
    assert measures.compute(nps, ["net_promoter_score"]).first()[0] == 25.0
    d = lambda *v: spark.createDataFrame([(x,) for x in v], "m int")
    assert rows(measures.response_rate(d(1, 1), d(1, 1, 1), d(1, 2), "m")) == [(1, 0.5), (2, 0.0)]
    f = spark.createDataFrame([(date(2024, 1, 1), 5.0), (date(2024, 6, 1), 7.0)], "d date, x double")
    assert measures.outstanding_over(f, date="d", amount="x").first()[0] == 5.0
    assert measures.per_distinct(f, "d").first()[0] == 1.0
    run = spark.createDataFrame([(T(2024, 1, 1),)], "end_ts timestamp")
    assert measures.freshness_hours(run, "2024-01-02 12:00:00").first()[0] == 36.0
    assert measures.scorecard(f, ["n"], ["d"], {"n": Measure("f", "count")}).count() == 3


def test_report_shapes(spark):
    m = spark.createDataFrame([("a", 1, 5), ("a", 2, 8), ("a", 4, 6), ("b", 1, 3)], "d string, p int, n int")
    assert sorted((r.d, r.p, r.n_change) for r in measures.period_over_period(m, "p", ["n"], ["d"]).collect()) == [("a", 1, None), ("a", 2, 3), ("a", 4, -2), ("b", 1, None)]
    a = spark.createDataFrame([(3, True, False), (7, False, True), (8, True, False), (40, False, True), (None, True, False)], "lead_time_days int, is_completed boolean, is_no_show boolean")
    assert {r.lead_band: r.no_show_rate for r in measures.no_show_by_lead(a).collect()} == {"0-7": 0.5, "8-14": 0.0, "30+": 1.0, None: 0.0}
    assert rows(measures.repeat_cohort(spark.createDataFrame([("x", True), ("x", True), ("y", True)], "p string, m boolean"), "p", F.col("m"))) == [("x", 2)]
    o = spark.createDataFrame([(date(2024, 6, 1), 5.0), (date(2024, 5, 2), 1.0), (date(2024, 1, 1), 7.0), (date(2024, 1, 2), 0.0)], "d date, x double")
    assert rows(measures.ageing(o, date="d", amount="x"), "age_band", "outstanding") == [("0-30", 6.0), ("over 90", 7.0)]
    f = {r.step: (r.n, r.of_previous) for r in measures.funnel(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (None, 1)], "a int, b int"), {"all": "true", "a": "a = 1", "b": "b = 1"}).collect()}
    assert f == {"all": (4, 1.0), "a": (2, 0.5), "b": (1, 0.5)}
    assert [r.rises for r in measures.monotone(spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 6.0)], "l int, v double"), "l", "v").orderBy("l").collect()] == [True, True, False]


def test_access(spark):
    df = spark.createDataFrame([(1, "secret", 5), (2, "x", 6)], "h int, name string, n int")
    scope = spark.createDataFrame([("u", 1)], "user_principal_name string, h int")
    roles = spark.createDataFrame([("u", "Clerk", False), ("boss", "Exec", False), ("all", "Any", True)], "user_principal_name string, role_name string, is_all_hospitals boolean")
    see = lambda u: access.apply_row_policy(df, user=u, scope=scope, key="h", roles=roles, bypass=["Exec"]).count()
    assert [see(u) for u in ("u", "boss", "all", "nobody")] == [1, 2, 2, 0]
    m = access.mask(df, {"name": access.partial_mask("name", 1, "--", 1), "n": "default"}, roles=["Clerk"], unmask=["Exec"])
    assert rows(m) == [(1, "s--t", 0), (2, "--", 0)] and rows(access.mask(df, {"n": "default"}, roles=["Exec"], unmask=["Exec"])) == rows(df)
    g = spark.createDataFrame([("R", "a", "GRANT"), ("R", "b", "GRANT"), ("S", "b", "DENY")], "role_name string, table_name string, effect string")
    assert rows(access.allowed_tables(g, ["R", "S"])) == [("a",)]
    dim = spark.createDataFrame([(1, "North")], "h int, region string")
    assert rows(access.deidentified(df, [(dim, "h")], ["region", "n"])) == [("North", 5)]


def test_registry_names_match():
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 60
