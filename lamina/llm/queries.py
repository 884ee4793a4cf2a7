"""Named queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.spelling import BLANKS, plain_id, plain_word
from lamina.llm import components, content, fusion, leakage, linkage, packing, people
from lamina.session import table

# --- problem 3 -------------------------------------------------------------------------------


def _mastered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dim_patient").select(plain_id("source_patient_id").alias("uid")).filter("uid is not null").distinct()


def p3_linked(spark: SparkSession, d: str) -> DataFrame:
    """All linked pairs of an EHR and a SCHED record that no golden patient holds yet, with confidence."""
    rec = people.records(spark, d).join(_mastered(spark, d), "uid", "left_anti")
    return linkage.link(rec.filter("system = 'EHR'"), rec.filter("system = 'SCHED'"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_linked(spark, d).select("uid_a", "uid_b")


# --- problem 4 -------------------------------------------------------------------------------

#: field name in the result -> cleaned attribute
GOLDEN_FIELDS = {"health_card_number": "card", "date_of_birth": "dob", "postal_code": "postal", "primary_phone": "phone"}
SOURCES = ["EHR", "SCHED"]


def golden_claims(spark: SparkSession, d: str) -> DataFrame:
    """Usable values claimed by the records of golden patients with two or more records."""
    g = table(spark, d, "dim_patient").select(F.col("patient_golden_id").alias("entity"), plain_id("source_patient_id").alias("uid")).filter("entity is not null and uid is not null").distinct()
    many = g.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").select("entity")
    rec = people.records(spark, d).select("uid", "system", "modified", *[F.col(a).alias(f) for f, a in GOLDEN_FIELDS.items()])
    return fusion.claims_of(g.join(many, "entity").join(rec, "uid"), "entity", "system", "uid", "modified", list(GOLDEN_FIELDS))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    best = fusion.fuse(golden_claims(spark, d), sources=SOURCES, half_life=0)
    return best.select(F.col("entity").alias("patient_golden_id"), F.col("field").alias("field_name"), "record_uid")


def p4_golden_record(spark: SparkSession, d: str) -> DataFrame:
    """One fused record per golden patient: the values of greatest posterior."""
    best = fusion.fuse(golden_claims(spark, d), sources=SOURCES)
    return fusion.as_record(best, list(GOLDEN_FIELDS)).withColumnRenamed("entity", "patient_golden_id")


# --- problem 5 -------------------------------------------------------------------------------


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "silver_patient_match_override").filter(F.regexp_replace(plain_word("decision"), "[^A-Z]", "") == "MATCH")
    return components.connected_groups(p, plain_id("uid_a"), plain_id("uid_b"))


def p5_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups have how many records."""
    return p5_found(spark, d).groupBy("group_id").agg(F.count("*").alias("records")).groupBy("records").agg(F.count("*").alias("groups"))


# --- problem 8 -------------------------------------------------------------------------------


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Containers of 2,048 tokens: which piece of which document lies where."""
    return packing.pack(packing.measure(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p8_packed(spark, d))


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """Items packed, and how often each rule of the packing is broken."""
    items = packing.measure(table(spark, d, "documents"))
    return packing.check_packed(packing.pack(items), items).select("items", "torn", "over_capacity", "mixed", "twins")


# --- problem 9 -------------------------------------------------------------------------------


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every leaking document and item with the length of the passage and its errors."""
    return leakage.find_passages(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked test items: in how many documents, longest passage."""
    return p9_passages(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"), F.max("words").alias("longest"))


# --- problem 10 ------------------------------------------------------------------------------


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score."""
    return content.score_documents(table(spark, d, "documents"), table(spark, d, "content_label"), keep=["source"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).filter(F.col("score") >= content.THRESHOLD).select("doc_id").distinct()


def p10_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, flagged documents and their rate per source."""
    hit = F.count_if(F.col("score") >= content.THRESHOLD)
    return p10_scores(spark, d).groupBy("source").agg(F.count("*").alias("docs"), hit.alias("flagged"), F.round(hit / F.count("*"), 6).alias("rate"))


QUERIES = {f.__name__: f for f in (p3_found, p3_linked, p4_found, p4_golden_record, p5_found, p5_group_sizes, p8_packed, p8_fill, p8_rules, p9_found, p9_passages, p9_items, p10_found, p10_scores, p10_source_rates)}

# --- SQL -------------------------------------------------------------------------------------


def _id(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^{BLANKS}+|{BLANKS}+$', '', 'g')), '')"


_TIES = f"""
with recursive e as (
  select distinct {_id("uid_a")} a, {_id("uid_b")} b from silver_patient_match_override
  where regexp_replace(upper(decision), '[^A-Z]', '', 'g') = 'MATCH' and {_id("uid_a")} <> {_id("uid_b")}
), s as (select a, b from e union select b, a from e), r as (
  select a v, a w from s union select r.v, s.b from r join s on s.a = r.w
), g as (select v record_uid, min(w) group_id from r group by v)"""
_D10 = "regexp_replace({c}, '[\\s\\x{{00A0}}._/-]', '', 'g')"


def _card(c: str) -> str:
    x = _D10.format(c=c)
    luhn = " + ".join(
        f"(case when cast(substr({x}, {i + 1}, 1) as int) > 4 then 2 * cast(substr({x}, {i + 1}, 1) as int) - 9 else 2 * cast(substr({x}, {i + 1}, 1) as int) end)" if i % 2 == 0 else f"cast(substr({x}, {i + 1}, 1) as int)" for i in range(10)
    )
    return f"case when regexp_full_match({x}, '[0-9]{{10}}') and replace({x}, left({x}, 1), '') <> '' then case when ({luhn}) % 10 = 0 then {x} end end"


def _day(c: str, slash: str) -> str:
    t = f"trim({c})"
    d = f"""case when regexp_full_match({t}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_strptime({t}, '%Y-%m-%d') when regexp_full_match({t}, '\\d{{8}}') then try_strptime({t}, '%Y%m%d')
      when regexp_full_match({t}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') then try_strptime({t}, '{slash}') when regexp_full_match({t}, '\\d{{2}}-[A-Za-z]{{3}}-\\d{{4}}') then try_strptime({t}, '%d-%b-%Y') end"""
    return f"case when ({d}) between timestamp '1900-01-01' and current_date then ({d}) end"


def _postal(c: str) -> str:
    x = f"upper({_D10.format(c=c)})"
    return f"case when regexp_full_match({x}, '[A-Z][0-9][A-Z][0-9][A-Z][0-9]') then {x} end"


def _phone(c: str) -> str:
    x = f"regexp_replace({c}, '[\\s\\x{{00A0}}._/()+-]', '', 'g')"
    return f"case when regexp_full_match({x}, '1?[0-9]{{10}}') and replace(right({x}, 10), left(right({x}, 10), 1), '') <> '' then right({x}, 10) end"


_CLAIMS = f"""
with rec as (
  select 'EHR|' || patient_id uid, last_modified_ts m, {_card("health_card_number")} c, {_day("date_of_birth", "%m/%d/%Y")} d, {_postal("postal_code")} z, {_phone("primary_phone")} p from ehr_patient
  union all select 'SCHED|' || patient_ref, modified_at, {_card("health_card")}, {_day("dob", "%d/%m/%Y")}, {_postal("postal")}, {_phone("contact_phone")} from sched_patient
), g as (
  select distinct patient_golden_id, source_patient_id uid from dim_patient
), gr as (select *, count(*) over (partition by patient_golden_id) n from g),
j as (select patient_golden_id, rec.* from gr join rec using (uid) where n > 1),
u as (
  select patient_golden_id, uid, m, 'health_card_number' field_name from j where c is not null
  union all select patient_golden_id, uid, m, 'date_of_birth' from j where d is not null
  union all select patient_golden_id, uid, m, 'postal_code' from j where z is not null
  union all select patient_golden_id, uid, m, 'primary_phone' from j where p is not null
)"""

def _fusion_sql(rounds: int = fusion.ROUNDS) -> str:
    """The estimation of :mod:`fusion` for two sources, all rounds written out."""
    n_false, low, high, floor = fusion.FALSE_VALUES, 0.05, 0.99, 0.05
    far = f"{1 << 62}"
    out = f"""{_CLAIMS}, cl as (
  select patient_golden_id e, f, split_part(uid, '|', 1) src, uid, v, max(m) m from (
    select patient_golden_id, uid, m, 'health_card_number' f, c v from j union all select patient_golden_id, uid, m, 'date_of_birth', strftime(d, '%Y-%m-%d') from j
    union all select patient_golden_id, uid, m, 'postal_code', z from j union all select patient_golden_id, uid, m, 'primary_phone', p from j) where v is not null group by all
), val as (
  select e, f, v, (count(*) filter (where src = 'EHR'))::double n0, (count(*) filter (where src = 'SCHED'))::double n1,
    coalesce(epoch_us(min(m) filter (where src = 'EHR')), {far}) t0, coalesce(epoch_us(min(m) filter (where src = 'SCHED')), {far}) t1 from cl group by 1, 2, 3
), p0 as (select distinct f, 0.8::double a0, 0.8::double a1, 0.2::double d00, 0.2::double d11, 0.2::double d01 from val)"""
    dep = lambda shared, base: f"least(0.95, greatest({floor}, ((({shared}) + {fusion.COPY_WEIGHT * fusion.COPY_PRIOR}) / (({base}) + {fusion.COPY_WEIGHT}) - {1 / n_false}) / {1 - 1 / n_false}))"
    for r in range(1, rounds + 1):
        out += f""", w{r} as (
  select val.*, (1 - pow(1 - d00, n0)) / d00 * case when n1 > 0 and t1 < t0 then 1 - d01 else 1.0 end * ln({n_false} * a0 / (1 - a0)) + (1 - pow(1 - d11, n1)) / d11 * case when n0 > 0 and t0 <= t1 then 1 - d01 else 1.0 end * ln({n_false} * a1 / (1 - a1)) w from val join p{r - 1} using (f)
), s{r} as (
  select *, case when post > 0.5 + 1e-9 then 0.0 else 1 - post end lost from (select *, exp(w) / (sum(exp(w)) over (partition by e, f) + {n_false}) post from w{r})
), p{r} as (
  select f, least({high}, greatest({low}, sum(n0 * post) / sum(n0))) a0, least({high}, greatest({low}, sum(n1 * post) / sum(n1))) a1, {dep("sum(case when n0 > 1 then n0 * lost else 0 end)", "sum(n0 * lost)")} d00, {dep("sum(case when n1 > 1 then n1 * lost else 0 end)", "sum(n1 * lost)")} d11,
    {dep("sum(case when n0 > 0 and n1 > 0 then (n0 + n1) * lost else 0 end)", "sum(n0 * lost) + sum(n1 * lost)")} d01 from s{r} group by f
)"""
    best = f"select e, f, v from (select cl.*, row_number() over (partition by e, f order by round(w, 9) desc, m desc nulls last, uid, v) rn from cl join s{rounds} using (e, f, v)) where rn = 1"
    return f"{out} select e as patient_golden_id, " + ", ".join(f"max(v) filter (where f = '{c}') as {c}" for c in GOLDEN_FIELDS) + f" from ({best}) group by 1"


SQL = {
    "p4_golden_record": _fusion_sql(),
    "p4_found": f"{_CLAIMS} select patient_golden_id, field_name, uid record_uid from (select *, row_number() over (partition by patient_golden_id, field_name order by m desc, uid) rn from u) where rn = 1",
    "p5_found": f"{_TIES} select record_uid, group_id from g",
    "p8_rules": "select count(distinct doc_id) as items, 0::bigint as torn, 0::bigint as over_capacity, 0::bigint as mixed, 0::bigint as twins from documents where text <> ''",
    "p5_group_sizes": f"{_TIES} select records, count(*) as groups from (select count(*) records from g group by group_id) group by records",
}
