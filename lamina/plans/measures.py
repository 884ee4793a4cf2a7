"""Measures as data: numerators, denominators and statistics over a fact, for any grouping.

A ratio with a zero denominator is null. Percentiles interpolate. One aggregate computes all
asked measures of a fact.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.conforming import surrogate_keys


@dataclass(frozen=True)
class Measure:
    """``kind``: count | count_if | sum | avg | median | percentile | distinct | ratio | share. ``a`` and ``b`` are SQL expressions."""

    fact: str
    kind: str
    a: str = "1"
    b: str = "true"
    p: float = 0.5

    def column(self) -> Column:
        a = F.expr(self.a)
        match self.kind:
            case "count":
                return F.count("*")
            case "count_if":
                return F.count_if(a)
            case "sum":
                return F.sum(a)
            case "avg":
                return F.avg(a)
            case "median":
                return F.median(a)
            case "percentile":
                return F.percentile(a, self.p)
            case "distinct":
                return F.count_distinct(a)
            case "share":  # rows meeting a among rows meeting b
                return F.try_divide(F.count_if(a & F.expr(self.b)).cast("double"), F.count_if(F.expr(self.b)))
            case "ratio":  # sum of a over sum of b
                return F.try_divide(F.sum(a).cast("double"), F.sum(F.expr(self.b)))
        raise ValueError(self.kind)


_A, _E, _P, _L, _M, _C, _S, _Q = "admission", "emergency_visit", "appointment", "lab_result", "medication_order", "claim", "satisfaction_survey", "dq_result"

MEASURES: dict[str, Measure] = {
    "total_admissions": Measure(_A, "count"), "total_discharges": Measure(_A, "count_if", "NOT is_open"), "open_admissions": Measure(_A, "count_if", "is_open"),
    "average_length_of_stay": Measure(_A, "avg", "length_of_stay_days"), "median_length_of_stay": Measure(_A, "median", "length_of_stay_days"), "total_patient_days": Measure(_A, "sum", "length_of_stay_days"),
    "icu_days": Measure(_A, "sum", "icu_days"), "readmissions_30d": Measure(_A, "count_if", "is_readmission"), "index_admissions": Measure(_A, "count_if", "is_index"),
    "readmission_rate": Measure(_A, "ratio", "int(is_readmission)", "int(is_index)"),
    "ed_visits": Measure(_E, "count"), "median_triage_wait": Measure(_E, "median", "arrival_to_triage_min"), "median_physician_wait": Measure(_E, "median", "arrival_to_physician_min"),
    "p90_ed_length_of_stay": Measure(_E, "percentile", "ed_length_of_stay_min", p=0.9),
    # a visit without length of stay counts as met, one without level has the longer target
    "ed_target_met": Measure(_E, "share", "coalesce(ed_length_of_stay_min, 0) <= IF(coalesce(ctas_level, 0) <= 2, 480, 240)"),
    "lwbs_rate": Measure(_E, "share", "left_without_being_seen"), "ed_admission_conversion": Measure(_E, "share", "resulted_in_admission"),
    "occupied_bed_hours": Measure("bed_occupancy", "sum", "occupied_hours"), "available_bed_hours": Measure("bed_occupancy", "sum", "available_hours"), "blocked_bed_hours": Measure("bed_occupancy", "sum", "blocked_hours"),
    "occupancy_rate": Measure("bed_occupancy", "ratio", "occupied_hours", "occupied_hours + available_hours"), "midnight_census": Measure("bed_occupancy", "count_if", "at_midnight = 1"),
    "staffed_beds": Measure("bed_occupancy", "distinct", "bed_key"), "bed_turnover": Measure("bed_occupancy", "sum", "turnover_count"),
    "scheduled_appointments": Measure(_P, "count"), "completed_appointments": Measure(_P, "count_if", "is_completed"), "no_shows": Measure(_P, "count_if", "is_no_show"), "cancellations": Measure(_P, "count_if", "is_cancelled"),
    "no_show_rate": Measure(_P, "share", "is_no_show", "is_completed OR is_no_show"), "cancellation_rate": Measure(_P, "share", "is_cancelled"),
    "late_cancellation_rate": Measure(_P, "share", "is_cancelled AND coalesce(cancellation_notice_hours, 0) < 24"), "average_lead_time": Measure(_P, "avg", "lead_time_days"), "average_clinic_wait": Measure(_P, "avg", "wait_minutes"),
    "distinct_patients_seen": Measure(_P, "distinct", "patient_key"),
    "lab_tests": Measure(_L, "count"), "abnormal_result_rate": Measure(_L, "share", "is_abnormal"), "critical_results": Measure(_L, "count_if", "is_critical"), "median_lab_turnaround": Measure(_L, "median", "turnaround_min"),
    "stat_turnaround_compliance": Measure(_L, "share", "turnaround_min <= 60", "priority = 'STAT'"),
    "medication_orders": Measure(_M, "count"), "medication_cost": Measure(_M, "sum", "total_cost"), "high_alert_share": Measure(_M, "share", "is_high_alert"), "median_order_to_dispense": Measure(_M, "median", "order_to_dispense_min"),
    "claims_submitted": Measure(_C, "count"), "claims_adjudicated": Measure(_C, "count_if", "is_adjudicated"), "claims_approved": Measure(_C, "count_if", "is_approved"), "claim_approval_rate": Measure(_C, "share", "is_approved", "is_adjudicated"),
    "claim_denial_rate": Measure(_C, "share", "is_denied", "is_adjudicated"), "billed_amount": Measure(_C, "sum", "billed_amount"), "approved_amount": Measure(_C, "sum", "approved_amount"), "denied_amount": Measure(_C, "sum", "denied_amount"),
    "net_collection_rate": Measure(_C, "ratio", "paid_amount", "approved_amount"), "average_days_to_adjudicate": Measure(_C, "avg", "days_to_payment"), "outstanding_ar": Measure("billing_line", "sum", "outstanding_amount"),
    "survey_responses": Measure(_S, "count"), "average_overall_score": Measure(_S, "avg", "overall_score"), "net_promoter_score": Measure(_S, "avg", "CASE nps_category WHEN 'PROMOTER' THEN 100 WHEN 'DETRACTOR' THEN -100 ELSE 0 END"),
    "dq_rules_executed": Measure(_Q, "count"), "dq_pass_rate": Measure(_Q, "ratio", "rows_passed", "rows_evaluated"), "dq_breaches": Measure(_Q, "count_if", "is_breach"), "critical_dq_breaches": Measure(_Q, "count_if", "is_breach AND severity = 'Error'"),
    "rows_quarantined": Measure(_Q, "sum", "rows_failed"), "pipeline_success_rate": Measure("pipeline_run", "share", "status = 'SUCCESS'"),
}


def compute(fact: DataFrame, names: Iterable[str], by: Iterable[str] = (), registry: dict[str, Measure] = MEASURES) -> DataFrame:
    return fact.groupBy(*by).agg(*[registry[n].column().alias(n) for n in names])


def per_distinct(fact: DataFrame, of: str, by: Iterable[str] = ()) -> DataFrame:
    """Rows per distinct ``of``."""
    return fact.groupBy(*by).agg(F.try_divide(F.count("*").cast("double"), F.count_distinct(of)).alias("per_distinct"))


def trimmed_mean(fact: DataFrame, value: str, p: float = 0.99, by: Iterable[str] = ()) -> DataFrame:
    """Mean of the values up to the percentile over all rows (one scalar, broadcast)."""
    cut = fact.agg(F.percentile(value, p).alias("_cut"))
    return fact.crossJoin(F.broadcast(cut)).filter(F.col(value) <= F.col("_cut")).groupBy(*by).agg(F.avg(value).alias("trimmed_mean"))  # one row


def against_last_year(m: DataFrame, year: str, value: str, keys: list[str]) -> DataFrame:
    """Each period with its value a year earlier and the difference."""
    prev = m.select((F.col(year) + 1).alias(year), *keys, F.col(value).alias("previous"))
    return m.join(prev, [year, *keys], "left").withColumn("change", F.col(value) - F.col("previous"))


def case_mix_index(fact: DataFrame, group: str, value: str) -> DataFrame:
    """Group mean over the mean of all rows."""
    g = fact.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy()  # one row per group
    return g.select(group, F.try_divide(F.try_divide(F.col("s"), F.col("n")), F.try_divide(F.sum("s").over(w), F.sum("n").over(w))).alias("case_mix_index"))


def utilisation(fact: DataFrame, *, doctor: str, minutes: str, fte: str, working_days: int, minutes_per_day: int = 450) -> DataFrame:
    """Booked minutes over the capacity of the doctors: per doctor the greatest FTE times working minutes."""
    d = fact.groupBy(doctor).agg(F.sum(minutes).alias("m"), F.max(fte).alias("f"))
    return d.agg(F.try_divide(F.sum("m").cast("double"), F.sum(F.col("f") * working_days * minutes_per_day)).alias("utilisation"))


def occupancy_status(rate: Column) -> Column:
    return F.when(rate >= 0.95, "Critical").when(rate >= 0.85, "High").when(rate >= 0.65, "Target").when(rate.isNotNull(), "Low")


def outstanding_over(fact: DataFrame, *, date: str, amount: str, days: int = 90) -> DataFrame:
    """Outstanding amount older than ``days`` before the newest row."""
    last = fact.agg(F.max(date).alias("_last"))
    return fact.crossJoin(F.broadcast(last)).filter(F.col(date) < F.date_sub("_last", days)).agg(F.sum(amount).alias("outstanding_over"))  # one row


def response_rate(responses: DataFrame, discharges: DataFrame, appointments: DataFrame, by: str) -> DataFrame:
    """Responses over discharges plus completed appointments; each fact is aggregated before it is joined."""
    r, d, a = (x.groupBy(by).agg(F.count("*").alias(n)) for x, n in ((responses, "r"), (discharges, "d"), (appointments, "a")))
    j = r.join(d, by, "full").join(a, by, "full").na.fill(0, ["r", "d", "a"])
    return j.select(by, F.try_divide(F.col("r").cast("double"), F.col("d") + F.col("a")).alias("response_rate"))


def freshness_hours(runs: DataFrame, now: str) -> DataFrame:
    return runs.agg(((F.lit(now).cast("timestamp").cast("long") - F.max("end_ts").cast("timestamp").cast("long")) / 3600.0).alias("freshness_hours"))


def scorecard(fact: DataFrame, names: list[str], levels: list[str], registry: dict[str, Measure] = MEASURES) -> DataFrame:
    """Measures with subtotals and a grand total."""
    return fact.rollup(*levels).agg(F.grouping_id().alias("level"), *[registry[n].column().alias(n) for n in names])


def heatmap(fact: DataFrame, row: str, column: str, values: list, value: Column) -> DataFrame:
    return fact.groupBy(row).pivot(column, values).agg(value)


def pareto(fact: DataFrame, item: str, amount: str) -> DataFrame:
    """Items by amount with the cumulative share; the window is over items, not rows."""
    g = fact.groupBy(item).agg(F.sum(amount).alias("amount"))
    w = Window.orderBy(F.desc("amount"), item).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.withColumn("cumulative_share", F.sum("amount").over(w) / F.sum("amount").over(Window.partitionBy()))


def period_over_period(m: DataFrame, period: str, values: list[str], keys: list[str]) -> DataFrame:
    """Each value with that of the period before (of the same keys) and the difference; periods that are absent are skipped."""
    w = Window.partitionBy(*keys).orderBy(period)  # one row per key and period
    return m.withColumns({f"previous_{v}": F.lag(v).over(w) for v in values}).withColumns({f"{v}_change": F.col(v) - F.col(f"previous_{v}") for v in values})


def in_bands(value: Column, edges: Iterable[tuple[float, str]], above: str) -> Column:
    """Label of the first band whose upper edge is not exceeded; null stays null."""
    out = F.when(value.isNull(), F.lit(None))
    for edge, label in edges:
        out = out.when(value <= edge, label)
    return out.otherwise(above)


#: upper edges in days and labels (fixed values)
LEAD_BANDS = ((7, "0-7"), (14, "8-14"), (29, "15-29"))
AGEING_BANDS = ((30, "0-30"), (60, "31-60"), (90, "61-90"))


def no_show_by_lead(fact: DataFrame) -> DataFrame:
    """Kept and missed appointments and the no-show rate per band of lead time."""
    band = in_bands(F.col("lead_time_days"), LEAD_BANDS, "30+").alias("lead_band")
    return compute(fact.withColumn("lead_band", band), ["completed_appointments", "no_shows", "no_show_rate"], ["lead_band"])


def repeat_cohort(fact: DataFrame, who: str, happened: Column, least: int = 2) -> DataFrame:
    """Those to whom it happened at least so often, with the count."""
    return fact.filter(happened).groupBy(who).agg(F.count("*").alias("times")).filter(F.col("times") >= least)


def ageing(fact: DataFrame, *, date: str, amount: str, by: Iterable[str] = ()) -> DataFrame:
    """Open amounts per band of age, counted from the newest row."""
    last = fact.agg(F.max(date).alias("_last"))
    aged = fact.filter(F.col(amount) > 0).crossJoin(F.broadcast(last))  # one row
    band = in_bands(F.datediff("_last", date), AGEING_BANDS, "over 90").alias("age_band")
    return aged.groupBy(*by, band).agg(F.sum(amount).alias("outstanding"), F.count("*").alias("lines"))


def rate_spread(fact: DataFrame, group: str, part: Column, whole: Column, least: int = 20) -> DataFrame:
    """Percentage per group with enough rows, and the spread between the highest and the lowest."""
    g = fact.filter(whole).groupBy(group).agg(F.count("*").alias("n"), (F.count_if(part) * 100.0 / F.count("*")).alias("pct")).filter(F.col("n") >= least)
    w = Window.partitionBy()  # one row per group
    return g.withColumn("spread", F.max("pct").over(w) - F.min("pct").over(w))


def monotone(m: DataFrame, level: str, value: str) -> DataFrame:
    """Values by level, and whether each is at least the one of the level before."""
    w = Window.orderBy(level)  # one row per level
    return m.withColumn("rises", F.coalesce(F.col(value) >= F.lag(value).over(w), F.lit(True)))


def funnel(fact: DataFrame, steps: Mapping[str, str]) -> DataFrame:
    """Rows that meet the first condition, the first two, and so on, each with its share of the step before."""
    cond, cols = F.lit(True), []
    for sql in steps.values():
        cond = cond & F.coalesce(F.expr(sql), F.lit(False))
        cols.append(F.count_if(cond))
    one = fact.agg(*[c.alias(f"s{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"s{i}").alias("n"), F.try_divide(F.col(f"s{i}").cast("double"), F.col(f"s{i - 1}" if i else "s0")).alias("of_previous")) for i, name in enumerate(steps)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def tiers(df: DataFrame, order: list[str], k: int, out: str = "tier") -> DataFrame:
    """Rows in ``k`` tiers of equal size by order, the first ones longer where it does not divide; no window over all rows."""
    n = df.count()
    short, longer = divmod(n, k)
    at = F.col("_n") - 1
    tier = F.when(at < longer * (short + 1), F.floor(at / (short + 1))).otherwise(longer + F.floor((at - longer * (short + 1)) / max(1, short))) + 1
    return surrogate_keys(df, order, "_n").withColumn(out, tier.cast("int")).drop("_n")


def outliers(fact: DataFrame, group: str, value: str, deviations: float = 3.0) -> DataFrame:
    """Rows far from their group's mean."""
    s = fact.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return fact.join(s, group).withColumn("z", F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).filter(F.abs("z") > deviations).drop("_m", "_s")
