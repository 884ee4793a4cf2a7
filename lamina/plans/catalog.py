"""Named queries of the library's own operators on the shared tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import scalar as fn
from lamina.functions.spelling import BLANKS, plain_id
from lamina.operators import access, conforming, identity, occupancy, quality
from lamina.plans import conform as entities
from lamina.plans import dims, measures
from lamina.plans.measures import Measure
from lamina.session import table
from lamina.sources import control, edi, files, hl7, rest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add



# --- column functions ---------------------------------------------------------------------------------


@query("select p_partkey, nullif(upper(trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g'))), '') as std_name from part")
def std_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.std_string(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("std_name"))


@query("select patient_id, last_modified_ts, case when regexp_full_match(upper(regexp_replace(postal_code, '[^A-Za-z0-9]', '', 'g')), '[A-Z][0-9][A-Z][0-9][A-Z][0-9]') then upper(regexp_replace(postal_code, '[^A-Za-z0-9]', '', 'g')) end as postal, left(case when regexp_full_match(upper(regexp_replace(postal_code, '[^A-Za-z0-9]', '', 'g')), '[A-Z][0-9][A-Z][0-9][A-Z][0-9]') then upper(regexp_replace(postal_code, '[^A-Za-z0-9]', '', 'g')) end, 3) as area from ehr_patient")
def std_postal(spark: SparkSession, d: str) -> DataFrame:
    p = fn.std_postal_code("postal_code")
    return table(spark, d, "ehr_patient").select("patient_id", "last_modified_ts", p.alias("postal"), fn.postal_area(p).alias("area"))


_DIG = "regexp_replace(primary_phone, '[^0-9]', '', 'g')"


@query(f"select patient_id, last_modified_ts, case when length({_DIG}) = 10 then '+1' || {_DIG} when regexp_full_match({_DIG}, '1[0-9]{{10}}') then '+' || {_DIG} end as phone from ehr_patient")
def std_phone(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ehr_patient").select("patient_id", "last_modified_ts", fn.std_phone("primary_phone").alias("phone"))


_HC = "regexp_replace(health_card_number, '[^0-9]', '', 'g')"
_LUHN = " + ".join(f"(case when cast(substr({_HC}, {i + 1}, 1) as int) > 4 then 2 * cast(substr({_HC}, {i + 1}, 1) as int) - 9 else 2 * cast(substr({_HC}, {i + 1}, 1) as int) end)" if i % 2 == 0 else f"cast(substr({_HC}, {i + 1}, 1) as int)" for i in range(10))


@query(f"select patient_id, last_modified_ts, coalesce(case when length({_HC}) = 10 then ({_LUHN}) % 10 = 0 end, false) as valid from ehr_patient")
def card_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ehr_patient").select("patient_id", "last_modified_ts", fn.health_card_valid("health_card_number").alias("valid"))


@query("""with x as (select patient_ref, modified_at, coalesce(case when regexp_full_match(trim(dob), '\\d{4}-\\d{2}-\\d{2}') then try_strptime(trim(dob), '%Y-%m-%d') end, case when regexp_full_match(trim(dob), '\\d{2}/\\d{2}/\\d{4}') then coalesce(try_strptime(trim(dob), '%d/%m/%Y'), try_strptime(trim(dob), '%m/%d/%Y')) end)::date as b from sched_patient),
y as (select patient_ref, modified_at, case when b between date '1900-01-01' and date '2025-12-31' then b end as birth_date from x)
select *, case when birth_date is null then 'Unknown' when n < 18 then '0-17' when n < 35 then '18-34' when n < 50 then '35-49' when n < 65 then '50-64' when n < 75 then '65-74' when n < 85 then '75-84' else '85+' end as band from (select *, datesub('year', birth_date, date '2025-12-31') n from y)""".replace("select *, case when birth_date", "select patient_ref, modified_at, birth_date, case when birth_date"))
def birth_dates(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2025-12-31").cast("date")
    b = fn.plausible_birth_date(fn.parse_birth_date("dob"), as_of)
    return table(spark, d, "sched_patient").select("patient_ref", "modified_at", b.alias("birth_date")).withColumn("band", fn.age_band("birth_date", as_of))


@query("select o_orderkey, sha256(concat_ws('||', coalesce(upper(trim(cast(o_orderkey as varchar))), '<NULL>'), coalesce(upper(trim(o_orderstatus)), '<NULL>'), coalesce(upper(trim(o_orderpriority)), '<NULL>'))) as row_hash, sha256(upper(trim(o_orderpriority)) || 'pepper') as token from orders")
def row_hash(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", fn.row_hash_of(["o_orderkey", "o_orderstatus", "o_orderpriority"]).alias("row_hash"), fn.token_of("o_orderpriority", "pepper").alias("token"))


_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_UP = f"translate(coalesce(last_name, ''), '{_ABC.lower()}', '{_ABC}')"
# class of each letter: vowels 0, H and W (which never part equal classes) dropped, other signs part them like vowels
_CLASS = lambda x: f"translate({x}, '{_ABC}', '01230127022455012623017202')"
_REST = "regexp_replace(regexp_replace(substr(u, 2), '[HW]', '', 'g'), '[^A-Z]', 'A', 'g')"
_SEQ = f"({_CLASS('left(u, 1)')} || {_CLASS(_REST)})"


def _once_each(x: str) -> str:
    for c in "123456":
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return x


@query(f"select sound, count(*) as n from (select case when u = '' then '' when not regexp_matches(left(u, 1), '[A-Z]') then coalesce(last_name, '') else left(u, 1) || rpad(left(replace(substr({_once_each(_SEQ)}, 2), '0', ''), 3), 3, '0') end as sound from (select last_name, {_UP} as u from ehr_patient)) group by 1")
def name_sounds(spark: SparkSession, d: str) -> DataFrame:
    """Sound codes of family names with how often each occurs."""
    return table(spark, d, "ehr_patient").groupBy(fn.name_sound("last_name").alias("sound")).agg(F.count("*").alias("n"))


# DuckDB counts bytes in its edit distance, so letters beyond ASCII are replaced on both sides
@query("select patient_id, last_modified_ts, cast(round(1 - levenshtein(f, l)::double / greatest(length(f), length(l), 5), 6) as double) as sim from (select patient_id, last_modified_ts, regexp_replace(first_name, '[^ -~]', '?', 'g') f, regexp_replace(last_name, '[^ -~]', '?', 'g') l from ehr_patient where first_name is not null and last_name is not null)")
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ehr_patient").filter("first_name is not null and last_name is not null")
    ascii_of = lambda c: F.regexp_replace(c, "[^ -~]", "?")
    return e.select("patient_id", "last_modified_ts", F.round(fn.name_similarity(ascii_of("first_name"), ascii_of("last_name")), 6).alias("sim"))


@query("""select admission_id, last_modified_ts, case when discharge_ts >= admission_ts then round((epoch(discharge_ts) - epoch(admission_ts)) / 60.0, 4) end::double as minutes,
case when date_diff('day', admission_ts, discharge_ts) >= 0 then greatest(date_diff('day', admission_ts, discharge_ts), 1) end::int as days, round((epoch(discharge_ts) - epoch(admission_ts)) / 3600.0, 4)::double as hours from admission""")
def stay_lengths(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "admission")
    return a.select("admission_id", "last_modified_ts", F.round(fn.minutes_between("admission_ts", "discharge_ts"), 4).alias("minutes"), fn.stay_days("admission_ts", "discharge_ts").alias("days"), F.round(fn.stay_hours("admission_ts", "discharge_ts"), 4).alias("hours"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, try_cast(l_returnflag as int) is null as no_level, case when l_linenumber between 1 and 5 then l_linenumber end as level, case when l_returnflag not in ('A', 'R') then l_returnflag end as code, l_linestatus like 'O%' as cancelled_like from lineitem""")
def levels_and_codes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return li.select(*keys, fn.level_1_to_5("l_returnflag").isNull().alias("no_level"), fn.level_1_to_5(F.col("l_linenumber").cast("string")).alias("level"), fn.without_codes("l_returnflag", ("A", "R")).alias("code"), F.col("l_linestatus").startswith("O").alias("cancelled_like"))


@query("select o_orderkey, coalesce(cast(strftime(o_orderdate, '%Y%m%d') as int), -1) as date_key, (hour(o_orderdate) * 60 + minute(o_orderdate))::int as time_key, split_part(o_orderpriority, '-', 1) as priority_no, split_part(o_orderpriority, '-', 2) as priority_text from orders")
def fact_keys(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", fn.date_key("o_orderdate").alias("date_key"), fn.time_key("o_orderdate").alias("time_key"), fn.split_member("o_orderpriority", "-", 0).alias("priority_no"), fn.split_member("o_orderpriority", "-", 1).alias("priority_text"))


@query("""select cast(strftime(d, '%Y%m%d') as int) as date_key, d as full_date, (dayofweek(d) + 1)::int as day_of_week, dayname(d) as day_name, dayofweek(d) in (0, 6) as is_weekend, date_trunc('week', d)::date as week_start, month(d)::int as month_number, monthname(d) as month_name,
quarter(d)::int as quarter_number, year(d)::int as calendar_year, year(d - interval 3 month)::int as fiscal_year, quarter(d - interval 3 month)::int as fiscal_quarter, month(d - interval 3 month)::int as fiscal_period from (select unnest(generate_series(date '1995-01-01', date '2001-12-31', interval 1 day))::date as d)""")
def dim_calendar(spark: SparkSession, d: str) -> DataFrame:
    return dims.calendar(spark, "1995-01-01", "2001-12-31", unknown=False)


@query("""select n::int as time_key, (n // 60)::int as hour_number, (n % 60)::int as minute_number, lpad((n // 60)::varchar, 2, '0') || ':' || lpad((n % 60)::varchar, 2, '0') as clock,
case when n // 60 between 7 and 14 then 'Day' when n // 60 between 15 and 22 then 'Evening' else 'Night' end as shift_name from range(1440) t(n) union all select -1, null, null, 'UNKNOWN', null""")
def dim_minutes(spark: SparkSession, d: str) -> DataFrame:
    return dims.minutes(spark)


@query("select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", files.json_field("props", "k", "int").alias("k"))


@query("select department_id, string_agg(distinct hospital_id, ',' order by hospital_id) as hospitals from admission where department_id is not null group by 1")
def sorted_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "admission").filter("department_id is not null").groupBy("department_id").agg(fn.sorted_set("hospital_id").alias("hospitals"))


# --- sources and control -------------------------------------------------------------------------------


@query("select event_id, user_id, event_type from events where ts > timestamp '2024-01-10 00:00:00' and ts <= timestamp '2024-01-20 00:00:00'")
def incremental_window(spark: SparkSession, d: str) -> DataFrame:
    return files.changed_between(table(spark, d, "events"), "ts", "2024-01-10 00:00:00", "2024-01-20 00:00:00").select("event_id", "user_id", "event_type")


@query("select event_id, user_id from events where (ts, event_id) > (timestamp '2024-01-05 00:00:00', 100) order by ts, event_id limit 100")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return rest.keyset_page(table(spark, d, "events"), "ts", "event_id", ("2024-01-05 00:00:00", 100), 100).select("event_id", "user_id")


def _registry(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_type").distinct()
    return ev.select(F.lit("APP").alias("source_system"), F.col("event_type").alias("entity_name"), F.lit("relational").alias("connection_type"), (F.col("event_type") != "error").alias("is_active"), F.lit(60).alias("sla_minutes"))


@query("""with w as (select event_type, max(ts) m from events where event_type in ('view', 'click') group by 1) select 'APP' as source_system, e.event_type as entity_name, coalesce(strftime(m, '%Y-%m-%d %H:%M:%S'), '1900-01-01 00:00:00') as watermark_value from (select distinct event_type from events where event_type <> 'error') e left join w using (event_type)""")
def entities_to_ingest(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").filter("event_type in ('view', 'click')").groupBy(F.lit("APP").alias("source_system"), F.col("event_type").alias("entity_name")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("watermark_value"))
    return control.entities_to_ingest(_registry(spark, d), w).select("source_system", "entity_name", "watermark_value")


def _log(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("m"), F.min("ts").alias("s"), F.count("*").alias("n"))
    staged = F.col("event_type").isin("view", "click", "signup")
    none = F.lit(None).cast("string")
    return g.select(
        F.concat(F.lit("b-"), "event_type").alias("batch_id"), F.lit("load").alias("pipeline_name"), F.lit("APP").alias("source_system"), F.col("event_type").alias("entity_name"), none.alias("target_table"), F.lit("incremental").alias("load_type"),
        none.alias("watermark_from"), F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("watermark_to"), F.when(staged, "STAGED").otherwise("FAILED").alias("status"), F.col("n").alias("rows_read"), F.col("n").alias("rows_written"), F.lit(0).cast("long").alias("duration_seconds"), none.alias("error_message"),
        F.col("s").alias("start_ts"), F.col("m").alias("end_ts"),
    )


@query("select 'APP' as source_system, event_type as entity_name, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as watermark_value, 'b-' || event_type as last_batch_id from events where event_type in ('view', 'click', 'signup') group by event_type")
def commit_watermark(spark: SparkSession, d: str) -> DataFrame:
    empty = spark.createDataFrame([], "source_system string, entity_name string, watermark_value string, last_batch_id string, updated_ts timestamp")
    _, w = control.commit_staged(_log(spark, d), empty, now="2024-02-01 00:00:00")
    return w.filter("watermark_value is not null").select("source_system", "entity_name", "watermark_value", "last_batch_id")


@query("""select event_type as entity_name, case when event_type not in ('view', 'click', 'signup') then 'FAILED' when (epoch(timestamp '2024-01-30 12:00:00') - epoch(date_trunc('second', max(ts)))) / 60 > 60 then 'STALE' else 'OK' end as freshness from events where event_type <> 'error' group by event_type""")
def freshness_status(spark: SparkSession, d: str) -> DataFrame:
    done, _ = control.commit_staged(_log(spark, d), spark.createDataFrame([], "source_system string, entity_name string, watermark_value string, last_batch_id string, updated_ts timestamp"), now="2024-02-01 00:00:00")
    return control.freshness(_registry(spark, d), done, "2024-01-30 12:00:00").select("entity_name", "freshness")


# messages are made from order lines and parsed back; the SQL reads the lines themselves
_LINES = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as n from lineitem)"


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, d, "lineitem").withColumn("n", F.row_number().over(w))


def _joined(df: DataFrame, key: str, part: F.Column, sep: str) -> DataFrame:
    """One text per key: its parts in order."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", part.alias("s")))), lambda x: x["s"]), sep).alias("body"))


@query(f"select 'M' || l_orderkey as message_control_id, 'P' || l_orderkey as patient_id, 'E' || l_orderkey as encounter_id, 'O' || l_orderkey as placer_order_id, 'STAT' as priority, cast(n as varchar) as set_id, 'C' || l_partkey as loinc_code, 'a|b' || l_suppkey as result_value, l_returnflag as abnormal_flag from {_LINES}")
def hl7_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey").cast("string")
    obx = F.concat(F.lit("OBX|"), F.col("n").cast("string"), F.lit("|ST|C"), F.col("l_partkey").cast("string"), F.lit("^name^LN||a\\F\\b"), F.col("l_suppkey").cast("string"), F.lit("|u^x||"), "l_returnflag", F.lit("|||F|||20240101120000"))
    head = F.concat(F.lit("FHS|^~\\&\r\nMSH|^~\\&|APP|FAC|X|Y|20240101||ORU^R01|M"), k, F.lit("|P|2.5\nPID|1||P"), k, F.lit("^^^X\rPV1|1|I|D1^2|||||DOC^A|||||||||||E"), k, F.lit("\rORC|RE\rOBR|1|O"), k, F.lit("||CODE|S|20240101|20240101\r"))
    msgs = _joined(_numbered(spark, d), "l_orderkey", obx, "\r").select(F.concat(head, "body", F.lit("\rBTS|1")).alias("content"))
    return hl7.parse_results(msgs).select("message_control_id", "patient_id", "encounter_id", "placer_order_id", "priority", "set_id", "loinc_code", "result_value", "abnormal_flag")


_ISA = "ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *240101*1200*^*00501*000000001*0*P*:~"


def claim_files(spark: SparkSession, d: str) -> DataFrame:
    """Claim files of about two hundred claims, so that claim scope matters.

    Some claims name no payer, some have no lines, and half of the files name no submitter of their own.
    """
    k = F.col("l_orderkey")
    t = k.cast("string")
    line = F.concat(F.lit("LX*"), F.col("n").cast("string"), F.lit("~SV1*HC:S"), F.col("l_partkey").cast("string"), F.lit("*5.50*UN*1~DTP*472*D8*20240102"))
    claims = _joined(_numbered(spark, d), "l_orderkey", line, "~")
    payer = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("~NM1*PR*2*P*****PI*PAY"), t))
    lines = F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("~"), "body"))
    claim = F.concat(F.lit("HL*1**20~NM1*85*2*H*****XX*H"), (k % 27).cast("string"), F.lit("~HL*2*1*22~SBR*P*18*******CI~NM1*IL*1*A*B****MI*C"), t, payer, F.lit("~CLM*C"), t, F.lit("*100.00***11:B:1~DTP*472*D8*20240102~HI*ABK:I110"), lines)
    body = claims.select(F.pmod("l_orderkey", F.lit(199)).alias("file_no"), F.col("l_orderkey").alias("n"), claim.alias("s")).groupBy("file_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "~").alias("body"))
    names = F.when(F.col("file_no") % 2 == 0, "NM1*41*2*S*****46*SUBMIT~NM1*40*2*R*****46*RECV~").otherwise("")
    return body.select(F.col("file_no").cast("string").alias("file"), F.concat(F.lit(_ISA + "GS*HC~ST*837*0001~BHT*0019*00*1*20240101~"), names, "body", F.lit("~SE*9*0001~GE*1*1~IEA*1*000000001~")).alias("content"))


@query(f"""select '000000001' as interchange_control_number, case when l_orderkey % 199 % 2 = 0 then 'SUBMIT' else 'SENDER' end as submitter_id, case when l_orderkey % 199 % 2 = 0 then 'RECV' else 'RECEIVER' end as receiver_id, 'H' || (l_orderkey % 27) as billing_provider_npi, 'C' || l_orderkey as claim_number, case when l_orderkey % 11 = 0 then 'CI' else 'PAY' || l_orderkey end as payer_id,
'C' || l_orderkey as subscriber_member_id, '100.00' as billed_amount, '11' as place_of_service, '20240102' as service_date, 'I110' as primary_diagnosis_code, case when l_orderkey % 17 <> 0 then cast(n as varchar) end as line_number, case when l_orderkey % 17 <> 0 then 'S' || l_partkey end as service_code, case when l_orderkey % 17 <> 0 then '5.50' end as line_amount,
case when l_orderkey % 17 = 0 then 'Claim has no service lines' end as parse_error from {_LINES} where l_orderkey % 17 <> 0 or n = 1""")
def edi837_parse(spark: SparkSession, d: str) -> DataFrame:
    return edi.parse_claims(claim_files(spark, d)).select("interchange_control_number", "submitter_id", "receiver_id", "billing_provider_npi", "claim_number", "payer_id", "subscriber_member_id", "billed_amount", "place_of_service", "service_date", "primary_diagnosis_code", "line_number", "service_code", "line_amount", "parse_error")


def remittance_files(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    claim = F.concat(F.lit("CLP*C"), F.col("o_orderkey").cast("string"), F.lit("*"), F.when(F.col("o_orderstatus") == "F", "4").otherwise("1"), F.lit("*100.00*80.00*7.00*MC~CAS*CO*45*12.50**97*1.00~CAS*PR*2*3.00~NM1*QC*1*A*B~DTM*232*20240101"))
    body = o.select(F.pmod("o_orderkey", F.lit(97)).alias("file_no"), F.col("o_orderkey").alias("n"), claim.alias("s")).groupBy("file_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "~").alias("body"))
    fix = "GS*HP~ST*835*0001~BPR*I*500.00*C*ACH*CCP*01*9*DA*1*9**01*9*DA*1*20240203~TRN*1*CHK1*9~DTM*405*20240203~N1*PR*PAYER~N1*PE*PROV~LX*1~"
    return body.select(F.col("file_no").cast("string").alias("file"), F.concat(F.lit(_ISA + fix), "body", F.lit("~SE*9*0001~GE*1*1~IEA*1*000000001~")).alias("content"))


@query("select 'C' || o_orderkey as claim_number, case o_orderstatus when 'F' then '4' else '1' end as claim_status_code, '80.00' as paid_amount, '7.00' as patient_responsibility, 'ACH' as payment_method, '20240203' as payment_date, 'PAYER' as payer_name, 3::int as adjustments, 12.50::decimal(18, 2) as adjustment_amount, 45::varchar as adjustment_reason from orders")
def edi835_parse(spark: SparkSession, d: str) -> DataFrame:
    r = edi.parse_remittances(remittance_files(spark, d))
    return r.select("claim_number", "claim_status_code", "paid_amount", "patient_responsibility", "payment_method", "payment_date", "payer_name", F.size("adjustments").alias("adjustments"), "adjustment_amount", "adjustment_reason")


# --- quality -------------------------------------------------------------------------------------------


@query("select l_returnflag, count(*) filter (where l_discount <= 0.05) as passed, count(*) filter (where not coalesce(l_discount <= 0.05, false)) as failed from lineitem group by 1")
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    ok, bad = quality.quarantine(table(spark, d, "lineitem"), "l_discount <= 0.05", "discount above five percent")
    a, b = ok.groupBy("l_returnflag").agg(F.count("*").alias("passed")), bad.groupBy("l_returnflag").agg(F.count("*").alias("failed"))
    return a.join(b, "l_returnflag", "full").na.fill(0)


@query("""with x as (select count(*) n, count(*) filter (where admission_ts is not null) a, count(*) filter (where discharge_ts >= admission_ts) b, count(*) filter (where c = 1) u, count(*) filter (where attending_physician_id is null or did is not null) r
from (select a.*, count(*) over (partition by admission_id) c, did from admission a left join (select distinct doctor_id did from dim_doctor) on did = attending_physician_id))
select rule_id, n as rows_evaluated, p as rows_passed, n - p as rows_failed, round(p * 100.0 / n, 4)::double as pass_rate_pct, p * 100.0 / n < t as is_breach from x, lateral (values ('ADM-1', a, 100.0), ('ADM-2', b, 90.0), ('ADM-3', u, 100.0), ('ADM-4', r, 99.0)) v(rule_id, p, t)
union all select 'ADM-5', n, 0, n, 0.0::double, true from x""")
def dq_rule_results(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        quality.Rule("ADM-1", "admission_ts IS NOT NULL", severity="Error", action="FailBatch"), quality.Rule("ADM-2", "discharge_ts >= admission_ts", 90.0), quality.Rule("ADM-3", "admission_id", kind="unique"),
        quality.Rule("ADM-4", "attending_physician_id", 99.0, kind="reference", parent=(table(spark, d, "dim_doctor"), "doctor_id")), quality.Rule("ADM-5", "no_such_column > 1"),
    ]
    return quality.evaluate(table(spark, d, "admission"), rules).select("rule_id", "rows_evaluated", "rows_passed", "rows_failed", "pass_rate_pct", "is_breach")


@query("""with t as (select ts::date as day, sum(value) as v from events group by 1), w as (select *, avg(v) over s as m, stddev_samp(v) over s as sd from t window s as (order by day range between interval 90 day preceding and interval 1 day preceding))
select count(*) as rows_evaluated, count(*) filter (where m is null or sd is null or abs(v - m) <= 3 * sd) as rows_passed from w""")
def dq_trend(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return quality.evaluate(t, [quality.Rule("T-1", "v", kind="trend", at="day")]).select("rows_evaluated", "rows_passed")


@query("select 'ADM' as domain, 'EHR' as source_system, admission_type as source_code, count(*) as row_count from admission where coalesce(upper(trim(admission_type)), '') not in ('EMERG', 'ELECT') group by admission_type")
def unmapped_codes(spark: SparkSession, d: str) -> DataFrame:
    mapped = conforming.map_codes(table(spark, d, "admission"), _code_table(spark), domain="ADM", system="EHR", source="admission_type", target="std")
    return quality.unmapped_codes(mapped, "std", "admission_type", "ADM", "EHR")


def _code_table(spark: SparkSession) -> DataFrame:
    rows = [("ADM", "EHR", "EMERG", "EMERGENCY", "true"), ("ADM", "EHR", " emerg", "EMERGENCY", "true"), ("ADM", "EHR", "ELECT", "ELECTIVE", "true"), ("ADM", "EHR", "NEWBORN", "BIRTH", "false")]
    return spark.createDataFrame(rows, "domain string, source_system string, source_code string, standard_code string, is_active string")


# --- conforming ----------------------------------------------------------------------------------------


@query("select o_orderkey, case o_orderpriority when '1-URGENT' then 'URGENT' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' else 'UNKNOWN' end as std from orders")
def map_code_unknown(spark: SparkSession, d: str) -> DataFrame:
    rows = [("PRI", "ERP", c, s, "true") for c, s in (("1-URGENT", "URGENT"), ("2-high", "HIGH"), ("3-MEDIUM ", "MEDIUM"), ("3-MEDIUM", "MEDIUM"))]
    m = spark.createDataFrame(rows, "domain string, source_system string, source_code string, standard_code string, is_active string")
    return conforming.map_codes(table(spark, d, "orders"), m, domain="PRI", system="ERP", source="o_orderpriority", target="std").select("o_orderkey", "std")


@query("select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc) rn from lineitem) where rn = 1")
def dedupe_latest(spark: SparkSession, d: str) -> DataFrame:
    return conforming.latest(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query("""select o_custkey, arg_max(o_orderstatus, (o_orderdate, -rk, o_orderstatus)) filter (where o_orderstatus <> 'P') as status, arg_max(o_orderpriority, (o_orderdate, -rk, o_orderpriority)) as priority from (select *, cast(left(o_orderpriority, 1) as int) as rk from orders) group by 1""")
def golden_survivorship(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("rk", F.substring("o_orderpriority", 1, 1).cast("int")).withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).withColumn("priority", F.col("o_orderpriority"))
    return conforming.survive(o, ["o_custkey"], ["status", "priority"], "o_orderdate", "rk")


@query("select c_custkey, row_number() over (order by c_mktsegment, c_custkey) as customer_key from customer")
def surrogate_keys(spark: SparkSession, d: str) -> DataFrame:
    return conforming.surrogate_keys(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"], "customer_key").select("c_custkey", "customer_key")


def _supplier_v(spark: SparkSession, d: str, changed: bool) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("supplier_id"), F.col("s_nationkey").alias("nation"), "s_name")
    if not changed:
        return s.filter(F.col("supplier_id").cast("long") % 10 != 9)
    return s.withColumn("nation", F.when(F.col("supplier_id").cast("long") % 7 == 0, F.col("nation") + 1).otherwise(F.col("nation")))


_V2 = "(s_suppkey % 10 <> 9 and s_suppkey % 7 = 0)"


@query(f"""select supplier_id, nation, effective_from_ts, effective_to_ts, is_current from (
 select cast(s_suppkey as varchar) supplier_id, s_nationkey nation, timestamp '1900-01-01' effective_from_ts, case when {_V2} then timestamp '2024-06-01' else timestamp '9999-12-31 23:59:59' end effective_to_ts, not {_V2} is_current from supplier where s_suppkey % 10 <> 9
 union all select cast(s_suppkey as varchar), s_nationkey + 1, timestamp '2024-06-01', timestamp '9999-12-31 23:59:59', true from supplier where {_V2}
 union all select cast(s_suppkey as varchar), case when s_suppkey % 7 = 0 then s_nationkey + 1 else s_nationkey end, timestamp '1900-01-01', timestamp '9999-12-31 23:59:59', true from supplier where s_suppkey % 10 = 9)""")
def scd2_merge(spark: SparkSession, d: str) -> DataFrame:
    kw = {"business_key": "supplier_id", "tracked": ["nation"], "key": "supplier_key"}
    first = conforming.scd2_merge(None, _supplier_v(spark, d, False), run_ts="2024-01-01 00:00:00", **kw)
    return conforming.scd2_merge(first, _supplier_v(spark, d, True), run_ts="2024-06-01 00:00:00", **kw).select("supplier_id", "nation", "effective_from_ts", "effective_to_ts", "is_current")


@query("""with old as (select s_suppkey, row_number() over (order by cast(s_suppkey as varchar)) k from supplier where s_suppkey % 10 <> 9), fresh as (select s_suppkey, row_number() over (order by cast(s_suppkey as varchar)) + (select max(k) from old) k from supplier where s_suppkey % 10 = 9)
select cast(s_suppkey as varchar) supplier_id, k::bigint as supplier_key, case when s_suppkey % 7 = 0 then s_nationkey + 1 else s_nationkey end as nation from supplier join (select * from old union all select * from fresh) using (s_suppkey)""")
def scd1_keys(spark: SparkSession, d: str) -> DataFrame:
    first = conforming.surrogate_keys(_supplier_v(spark, d, False), ["supplier_id"], "supplier_key")
    return conforming.scd1_merge(first, _supplier_v(spark, d, True), business_key="supplier_id", key="supplier_key").select("supplier_id", "supplier_key", "nation")


@query("select n_nationkey::bigint as nation_key, n_name as nation_id from nation union all select -1, 'UNKNOWN' union all select -2, 'NOT APPLICABLE' union all select -3, 'LATE ARRIVING'")
def seed_unknown(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation_key"), F.col("n_name").alias("nation_id"))
    once = conforming.seed_unknown(n, key="nation_key", business_key="nation_id")
    return conforming.seed_unknown(once, key="nation_key", business_key="nation_id")


@query("select admission_id, last_modified_ts, coalesce(k, -1)::bigint as doctor_key from admission left join (select doctor_id, max(doctor_key) k from dim_doctor where is_current group by 1) on doctor_id = attending_physician_id")
def lookup_current(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "admission").select("admission_id", "last_modified_ts", "attending_physician_id")
    return conforming.lookup_current(a, table(spark, d, "dim_doctor"), business_key="attending_physician_id", dim_business_key="doctor_id", dim_key="doctor_key", out="doctor_key").drop("attending_physician_id")


@query("select a.admission_id, a.last_modified_ts, coalesce(d.doctor_key, -1)::bigint as doctor_key from admission a left join (select distinct * from dim_doctor) d on d.doctor_id = a.attending_physician_id and a.admission_ts >= d.effective_from_ts and a.admission_ts < d.effective_to_ts")
def lookup_temporal(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "admission").select("admission_id", "last_modified_ts", "attending_physician_id", "admission_ts")
    return conforming.lookup_at(a, table(spark, d, "dim_doctor").distinct(), business_key="attending_physician_id", at="admission_ts", dim_business_key="doctor_id", dim_key="doctor_key", out="doctor_key").drop("attending_physician_id", "admission_ts")


@query("""with x as (select source_patient_id u, min(patient_golden_id) g from dim_patient group by 1) select p.patient_id, p.last_modified_ts, coalesce(a.g, b.g) as golden from ehr_patient p left join x a on a.u = 'SCHED|' || p.patient_id left join x b on b.u = 'EHR|' || p.patient_id""")
def resolve_patient(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ehr_patient").select("patient_id", "last_modified_ts")
    return conforming.resolve(e, table(spark, d, "dim_patient"), [fn.record_uid("SCHED", "patient_id"), fn.record_uid("EHR", "patient_id")], uid="source_patient_id", golden="patient_golden_id", out="golden")


@query("select o_orderkey, c_custkey, o_totalprice from (select * from orders where o_orderstatus <> 'F' union all select * replace (o_totalprice + 1 as o_totalprice) from orders where o_orderstatus = 'F') join customer on c_custkey = o_custkey")
def upsert_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    merged = conforming.upsert(o, o.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])
    return merged.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "o_totalprice")


_ADM_RAW = "select * from (select *, row_number() over (partition by admission_id order by last_modified_ts desc) rn from admission) where rn = 1"


@query(f"""with a as ({_ADM_RAW}), b as (select admission_id, admission_ts, case when discharge_ts >= admission_ts then discharge_ts end as dis, case when upper(trim(admission_type)) = 'EMERG' then 'EMERGENCY' when upper(trim(admission_type)) = 'ELECT' then 'ELECTIVE' else 'UNKNOWN' end as admission_type_std from a where admission_ts is not null)
select admission_id, admission_type_std, case when dis is not null then greatest(date_diff('day', admission_ts, dis), 1) end::int as length_of_stay_days, dis is null as is_open from b""")
def silver_admission(spark: SparkSession, d: str) -> DataFrame:
    spec = entities.SPECS["admission"]
    m = _code_table(spark).withColumn("domain", F.lit("ADMIT_TYPE"))
    ok, _ = entities.conform(table(spark, d, "admission"), spec, order=["last_modified_ts"], mapping=m)
    return ok.select("admission_id", "admission_type_std", "length_of_stay_days", "is_open")


# --- identity ------------------------------------------------------------------------------------------


def _people(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.concat(F.lit("C|"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("record_uid"), F.col("c_name").alias("family"), F.col("c_mktsegment").alias("given"), F.col("c_nationkey").cast("string").alias("postal"), F.round("c_acctbal", -1).cast("int").cast("string").alias("card"),
        F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") % 40).cast("int")).alias("birth_date"), F.when(F.col("c_custkey") % 5 == 0, "UNKNOWN").when(F.col("c_custkey") % 5 == 1, "M").otherwise("F").alias("sex"), F.when(F.col("c_custkey") % 9 != 0, (F.col("c_custkey") % 50).cast("string")).alias("phone"),
    )


_P = "(select 'C|' || lpad(c_custkey::varchar, 9, '0') as u, c_name as fam, c_mktsegment as giv, c_nationkey::varchar as pos, cast(round(c_acctbal / 10) * 10 as int)::varchar as card, date '1960-01-01' + (c_custkey % 40)::int as dob, case c_custkey % 5 when 0 then 'UNKNOWN' when 1 then 'M' else 'F' end as sex, case when c_custkey % 9 <> 0 then (c_custkey % 50)::varchar end as tel from customer)"
_KEYS = {"card": ["card"], "area": ["postal", "given"]}
_BLOCKS = f"(select u, 'card|' || card as block from {_P} where card is not null union select u, 'area|' || pos || '|' || giv from {_P} where pos is not null and giv is not null)"
_SIZES = f"(select block, count(*) n from {_BLOCKS} group by 1)"
_PAIRS = f"(select distinct a.u as uid_a, b.u as uid_b from {_BLOCKS} a join {_BLOCKS} b on a.block = b.block and a.u < b.u join {_SIZES} s on s.block = a.block where s.n > 1)"
_SCORE = f"""(select uid_a, uid_b, case when a.card = b.card then 12.0 else -6.0 end + case when 1 - levenshtein(a.fam, b.fam)::double / greatest(length(a.fam), length(b.fam), 5) >= 0.9 then 4.0 else -3.0 end
 + case when 1 - levenshtein(a.giv, b.giv)::double / greatest(length(a.giv), length(b.giv), 5) >= 0.88 then 3.0 else -2.0 end + case when a.pos = b.pos then 3.0 when left(a.pos, 3) = left(b.pos, 3) then 1.0 else -1.0 end
 + case when a.dob = b.dob then 6.0 when year(a.dob) = year(b.dob) and month(a.dob) = day(b.dob) and day(a.dob) = month(b.dob) then 5.0 when abs(date_diff('day', a.dob, b.dob)) <= 31 then 2.0 else -5.0 end + case when a.sex = 'UNKNOWN' or b.sex = 'UNKNOWN' then 0.0 when a.sex = b.sex then 1.0 else -3.0 end + case when a.tel is null or b.tel is null then 0.0 when a.tel = b.tel then 2.5 else -0.5 end as match_score
 from {_PAIRS} p join {_P} a on a.u = uid_a join {_P} b on b.u = uid_b)"""


def _keys() -> dict[str, list[Column]]:
    return {k: [F.col(c) for c in cols] for k, cols in _KEYS.items()}


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return identity.blocks(_people(spark, d), _keys())


def _scored(spark: SparkSession, d: str, at_least: float | None = None) -> DataFrame:
    return identity.score(identity.paired_by(_people(spark, d), _keys(), at_least=at_least), at_least=at_least).select("uid_a", "uid_b", "match_score")


@query(f"select uid_a, uid_b from {_PAIRS}")
def block_pairs(spark: SparkSession, d: str) -> DataFrame:
    return identity.pairs_by(_people(spark, d), _keys())


@query(f"select block, n as records from {_SIZES} where n > 10")
def oversized_blocks(spark: SparkSession, d: str) -> DataFrame:
    return identity.oversized(_blocks(spark, d), 10)


@query(f"select uid_a, uid_b, match_score::double as match_score, case when match_score >= 14 then 'AUTO_LINK' when match_score >= 8 then 'REVIEW' else 'DISTINCT' end as decision from {_SCORE}")
def match_decision(spark: SparkSession, d: str) -> DataFrame:
    return identity.decide(_scored(spark, d))


@query(f"""with recursive e as (select uid_a a, uid_b b from {_SCORE} where match_score >= 14), s as (select a, b from e union select b, a from e), r as (select u as v, u as w from {_P} union select r.v, s.b from r join s on s.a = r.w) select v as record_uid, min(w) as component from r group by v""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return identity.components(_people(spark, d).select("record_uid"), identity.decide(_scored(spark, d, identity.LINK_AT)).filter("decision = 'AUTO_LINK'"))


@query("""with t as (select source_patient_id u, min(patient_golden_id) g from dim_patient group by 1), p as (select u, case when c = '' then u else c end g from (select 'EHR|' || patient_id u, coalesce(min(regexp_replace(health_card_number, '[^0-9]', '', 'g')), '') c from ehr_patient group by 1 union all select 'SCHED|' || patient_ref, coalesce(min(regexp_replace(health_card, '[^0-9]', '', 'g')), '') from sched_patient group by 1)),
tp as (select a.u x, b.u y from t a join t b on a.g = b.g and a.u < b.u), pp as (select a.u x, b.u y from p a join p b on a.g = b.g and a.u < b.u), j as (select t.u, t.g tg, p.g pg from t join p using (u)), ct as (select tg, count(distinct pg) n, min(pg) pg from j group by 1), cp as (select pg, count(distinct tg) m from j group by 1)
select n as tp, m - n as fp, k - n as fn, (n::double / greatest(1, m)) as precision, (n::double / greatest(1, k)) as recall, (select count(*) from ct) as people, (select count(*) from ct where n > 1) as split_people, (select count(*) from cp where m > 1) as merged_ids, (select count(*) from ct join cp using (pg) where n = 1 and m = 1) as exact_people
from (select (select count(*) from (select * from tp intersect select * from pp)) n, (select count(*) from pp) m, (select count(*) from tp) k)""")
def pairwise_eval(spark: SparkSession, d: str) -> DataFrame:
    """Records grouped by their card digits, measured against the golden persons."""
    truth = table(spark, d, "dim_patient").groupBy(F.col("source_patient_id").alias("record_uid")).agg(F.min("patient_golden_id").alias("person"))
    side = lambda t, system, key, card: table(spark, d, t).groupBy(F.concat(F.lit(f"{system}|"), key).alias("record_uid")).agg(F.coalesce(F.min(F.regexp_replace(card, "[^0-9]", "")), F.lit("")).alias("c"))
    both = side("ehr_patient", "EHR", "patient_id", "health_card_number").unionByName(side("sched_patient", "SCHED", "patient_ref", "health_card"))
    p = both.filter("record_uid is not null").select("record_uid", F.when(F.col("c") == "", F.col("record_uid")).otherwise(F.col("c")).alias("patient_golden_id"))
    return identity.pairwise_evaluation(truth, p).select("tp", "fp", "fn", "precision", "recall", "people", "split_people", "merged_ids", "exact_people")


# --- joins, windows, occupancy --------------------------------------------------------------------------


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def orphan_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select r_name, p_brand, count(*) as n, cast(sum(l_extendedprice::decimal(18, 2)) as decimal(28, 2)) as amount from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey group by 1, 2")
def star_view(spark: SparkSession, d: str) -> DataFrame:
    dim = lambda name, **keys: (table(spark, d, name).withColumnsRenamed(keys), next(iter(keys.values())))
    joins = [dim("orders", o_orderkey="l_orderkey"), dim("customer", c_custkey="o_custkey"), dim("nation", n_nationkey="c_nationkey"), dim("region", r_regionkey="n_regionkey"), dim("part", p_partkey="l_partkey")]
    f = access.deidentified(table(spark, d, "lineitem"), joins, ["r_name", "p_brand", "l_extendedprice"])
    return f.groupBy("r_name", "p_brand").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))


@query("""with x as (select *, lag(o_orderdate) over w pd, lag(o_orderstatus) over w ps from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) select o_orderkey, date_diff('day', pd, o_orderdate)::int as days_since_previous, coalesce(date_diff('day', pd, o_orderdate) between 0 and 30 and o_orderpriority <> '5-LOW' and not coalesce(ps = 'F', false), false) as is_readmission, o_orderstatus <> 'F' as is_index from x""")
def readmission_flag(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    r = occupancy.readmissions(o, person="o_custkey", start="o_orderdate", end="o_orderdate", key="o_orderkey", planned=F.col("o_orderpriority") == "5-LOW", ended_elsewhere=F.col("o_orderstatus") == "F")
    return r.select("o_orderkey", "days_since_previous", "is_readmission", "is_index")


_BED = f"nullif(upper(regexp_replace(bed_id, '^{BLANKS}+|{BLANKS}+$', '', 'g')), '')"


@query(f"""with s as (select {_BED} b, greatest(assignment_start_ts, timestamp '2024-01-01') s, least(coalesce(assignment_end_ts, timestamp '2024-04-01'), timestamp '2024-04-01') e from bed_assignment where assignment_start_ts is not null and {_BED} is not null),
g as (select b, unnest(generate_series(date_trunc('day', s), e - interval 1 microsecond, interval 1 day)) d, s, e from s where s < e)
select b as bed, d::date as day, round(least(sum(epoch(least(e, d + interval 1 day)) - epoch(greatest(s, d))) / 3600.0, 24), 6)::double as occupied_hours, max((s <= d)::int) as at_midnight, count(*) as stays from g group by 1, 2""")
def bed_occupancy(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bed_assignment").withColumn("bed", plain_id("bed_id"))
    o = occupancy.daily_occupancy(b, unit="bed", start="assignment_start_ts", end="assignment_end_ts", first="2024-01-01", last="2024-03-31")
    return o.withColumn("occupied_hours", F.round("occupied_hours", 6))


@query(f"""with a as ({_ADM_RAW}), d as (select unnest(generate_series(date '2023-01-31', date '2024-12-31', interval 7 day))::date as day)
select day, count(admission_id) as census from d left join a on admission_ts::date <= day and (discharge_ts is null or greatest(discharge_ts::date, admission_ts::date) > day) group by 1""")
def census_asof(spark: SparkSession, d: str) -> DataFrame:
    a = conforming.latest(table(spark, d, "admission"), ["admission_id"], ["last_modified_ts"])
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2023-01-31").cast("date"), F.lit("2024-12-31").cast("date"), F.expr("interval 7 day"))).alias("day"))
    return occupancy.census(a, start="admission_ts", end="discharge_ts", days=days)


# --- measures and report shapes ------------------------------------------------------------------------

_SHIP = {
    "rows": Measure("line", "count"), "quantity": Measure("line", "sum", "cast(l_quantity as decimal(12,2))"), "median_lag": Measure("line", "median", "lag_days"), "p90_lag": Measure("line", "percentile", "lag_days", p=0.9),
    "mean_lag": Measure("line", "avg", "lag_days"), "returned_share": Measure("line", "share", "l_returnflag = 'R'", "l_returnflag <> 'N'"), "suppliers": Measure("line", "distinct", "l_suppkey"), "net_share": Measure("line", "ratio", "l_discount", "l_tax"),
}


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.withColumn("lag_days", F.datediff("l_shipdate", "o_orderdate"))


_LAG = "(select l.*, o.*, date_diff('day', o_orderdate, l_shipdate) as lag_days from lineitem l join orders o on l_orderkey = o_orderkey)"


@query(f"select o_orderpriority, count(*) as rows, cast(sum(l_quantity::decimal(12, 2)) as decimal(22, 2)) as quantity, median(lag_days)::double as median_lag, quantile_cont(lag_days, 0.9)::double as p90_lag, round(avg(lag_days), 6)::double as mean_lag, round(count(*) filter (where l_returnflag = 'R')::double / count(*) filter (where l_returnflag <> 'N'), 9) as returned_share, count(distinct l_suppkey) as suppliers, round(sum(l_discount) / sum(l_tax), 6) as net_share from {_LAG} group by 1")
def measures_by_group(spark: SparkSession, d: str) -> DataFrame:
    m = measures.compute(_lines(spark, d), _SHIP, ["o_orderpriority"], _SHIP)
    return m.withColumns({"mean_lag": F.round("mean_lag", 6), "returned_share": F.round("returned_share", 9), "net_share": F.round("net_share", 6)})


@query(f"select round(avg(lag_days), 6)::double as trimmed_mean from {_LAG} where lag_days <= (select quantile_cont(lag_days, 0.99) from {_LAG})")
def trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    return measures.trimmed_mean(_lines(spark, d), "lag_days").select(F.round("trimmed_mean", 6).alias("trimmed_mean"))


@query(f"select l_returnflag, round(avg(lag_days) / (select avg(lag_days) from {_LAG}), 9) as case_mix_index from {_LAG} group by 1")
def case_mix_index(spark: SparkSession, d: str) -> DataFrame:
    return measures.case_mix_index(_lines(spark, d), "l_returnflag", "lag_days").withColumn("case_mix_index", F.round("case_mix_index", 9))


@query("with m as (select year(o_orderdate)::int y, month(o_orderdate)::int m, count(*) n from orders group by 1, 2) select a.y, a.m, a.n, b.n as previous, a.n - b.n as change from m a left join m b on a.y = b.y + 1 and a.m = b.m")
def py_compare(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    return measures.against_last_year(m, "y", "n", ["m"])


@query("select o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) as level, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def scorecard_rollup(spark: SparkSession, d: str) -> DataFrame:
    return measures.scorecard(table(spark, d, "orders"), ["n"], ["o_orderstatus", "o_orderpriority"], {"n": Measure("orders", "count")})


@query("select hour(ts)::int as hr, count(*) filter (where dayofweek(ts) = 0) as d1, count(*) filter (where dayofweek(ts) = 1) as d2, count(*) filter (where dayofweek(ts) = 2) as d3, count(*) filter (where dayofweek(ts) = 3) as d4, count(*) filter (where dayofweek(ts) = 4) as d5, count(*) filter (where dayofweek(ts) = 5) as d6, count(*) filter (where dayofweek(ts) = 6) as d7 from events group by 1")
def hour_weekday_heatmap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.hour("ts").alias("hr"), F.concat(F.lit("d"), F.dayofweek("ts").cast("string")).alias("dow"))
    return measures.heatmap(e, "hr", "dow", [f"d{i}" for i in range(1, 8)], F.count(F.lit(1))).na.fill(0)


@query("with g as (select p_brand, sum(p_retailprice::decimal(18, 2)) as amount from part group by 1) select p_brand, cast(amount as decimal(28, 2)) as amount, round(sum(amount) over (order by amount desc, p_brand rows unbounded preceding)::double / sum(amount) over ()::double, 6) as cumulative_share from g")
def pareto(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("price", F.col("p_retailprice").cast("decimal(18,2)"))
    out = measures.pareto(p, "p_brand", "price")
    return out.withColumn("cumulative_share", F.round(F.col("cumulative_share").cast("double"), 6))


@query("select width_bucket, count(*) as n from (select least(greatest(floor(o_totalprice / 50000.0)::int + 1, 0), 11) as width_bucket from orders) group by 1")
def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.width_bucket("o_totalprice", F.lit(0.0), F.lit(500000.0), F.lit(10)).cast("int").alias("width_bucket")).agg(F.count("*").alias("n"))


@query("select o_orderstatus, round(corr(o_totalprice, l), 9) as r, count(*) as n from orders join (select l_orderkey, sum(l_quantity) l from lineitem group by 1) on l_orderkey = o_orderkey group by 1")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("l"))
    return table(spark, d, "orders").join(q, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.round(F.corr("o_totalprice", "l"), 9).alias("r"), F.count("*").alias("n"))


@query("select user_id, avg_value, ntile(3) over (order by avg_value, user_id)::int as tier from (select user_id, cast(round(avg(value), 4) as decimal(18, 4)) as avg_value from events group by 1)")
def user_tiers(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 4).cast("decimal(18,4)").alias("avg_value"))
    return measures.tiers(u, ["avg_value", "user_id"], 3)


@query("with s as (select event_type, avg(value) m, stddev_samp(value) sd from events group by 1) select event_id, round((value - m) / sd, 4) as z from events join s using (event_type) where abs((value - m) / sd) > 3")
def value_outliers(spark: SparkSession, d: str) -> DataFrame:
    return measures.outliers(table(spark, d, "events"), "event_type", "value").select("event_id", F.round("z", 4).alias("z"))


@query("select round(sum(m)::double / sum(f * 20 * 450), 9) as utilisation from (select l_suppkey, sum(l_quantity) m, max(1 + l_tax) f from lineitem group by 1)")
def utilisation(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("fte", 1 + F.col("l_tax"))
    return measures.utilisation(li, doctor="l_suppkey", minutes="l_quantity", fte="fte", working_days=20).select(F.round("utilisation", 9).alias("utilisation"))


@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where n_regionkey in (1, 3)")
def row_policy(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scope = spark.createDataFrame([("ann", 1), ("ann", 3), ("bob", 2)], "user_principal_name string, n_regionkey int")
    roles = spark.createDataFrame([("ann", "Analyst", False), ("eve", "Executive", True)], "user_principal_name string, role_name string, is_all_hospitals boolean")
    return access.apply_row_policy(c, user="ann", scope=scope, key="n_regionkey", roles=roles).select("c_custkey", "n_name")


@query("select c_custkey, case when length(c_name) <= 3 then 'XXX' else left(c_name, 2) || 'XXX' || right(c_name, 1) end as c_name, 0.0::double as c_acctbal, 'xxxx' as c_mktsegment from customer")
def masking(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").drop("c_nationkey")
    return access.mask(c, {"c_name": access.partial_mask("c_name", 2, "XXX", 1), "c_acctbal": "default", "c_mktsegment": "default"}, roles=["Analyst"], unmask=["Steward"])


