"""HL7 v2 result messages to rows, in Spark expressions only (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.quality import QualityGateError

#: result column -> (segment, field index after splitting on the bar, component from 0 or None) (fixed wire positions)
POSITIONS = {
    "message_control_id": ("MSH", 9, None), "sending_facility": ("MSH", 3, None), "message_ts": ("MSH", 6, None), "patient_id": ("PID", 3, 0), "encounter_id": ("PV1", 19, None),
    "department_id": ("PV1", 3, None), "ordering_doctor_id": ("PV1", 8, None), "placer_order_id": ("OBR", 2, None), "order_ts": ("OBR", 6, None), "collect_ts": ("OBR", 7, None),
    "set_id": ("OBX", 1, None), "value_type": ("OBX", 2, None), "loinc_code": ("OBX", 3, 0), "result_value": ("OBX", 5, None), "result_unit": ("OBX", 6, None),
    "abnormal_flag": ("OBX", 8, None), "result_status": ("OBX", 11, None),
}
NO_RESULT = "No OBX segment in message"
#: escape sequences and their characters, in the order of replacement (fixed values)
ESCAPES = (("\\F\\", "|"), ("\\S\\", "^"), ("\\R\\", "~"), ("\\T\\", "&"), ("\\E\\", "\\"))


def unescape(c: Column) -> Column:
    for seq, ch in ESCAPES:
        c = F.replace(c, F.lit(seq), F.lit(ch))
    return c


def _field(seg: Column, index: int, component: int | None) -> Column:
    v = F.get(F.split(seg, "[|]"), F.lit(index))
    if component is not None:
        v = F.get(F.split(v, r"\^"), F.lit(component))
    return F.nullif(unescape(v), F.lit(""))


def split_messages(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per message with its segments in order; batch envelopes and text before the first message are dropped."""
    text = F.regexp_replace(F.col(content), "\r\n|\n", "\r")
    segs = F.filter(F.split(text, "\r"), lambda s: (F.trim(s) != "") & ~F.substring(s, 1, 3).isin("FHS", "BHS", "BTS", "FTS"))
    # a message begins where a segment begins with MSH
    msgs = F.filter(F.split(F.array_join(segs, "\r"), r"(?:^|\r)(?=MSH)"), lambda m: m.startswith("MSH"))
    return files.select("*", F.posexplode_outer(msgs).alias("message_no", "_msg")).withColumn("segments", F.split("_msg", "\r")).drop("_msg")


def parse_results(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per result segment, with the order segment before it.

    A message without results gives one row with ``parse_error``; an empty file gives one row of
    nulls. Message, patient and visit fields come from the first such segment of the
    message; a result belongs to the latest order segment before it.
    """
    m = split_messages(files, content)
    first = lambda tag: F.get(F.filter("segments", lambda s: s.startswith(tag)), F.lit(0))
    at = lambda tag: F.filter(F.transform("segments", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"].startswith(tag))
    m = m.select(*keep, "message_no", *[first(tag).alias(tag) for tag in ("MSH", "PID", "PV1")], at("OBX").alias("_x"), at("OBR").alias("_r"))
    # results and orders are paired inside the message; only the pair goes on, not the message
    before = lambda i: F.filter("_r", lambda r: r["i"] < i)
    last = lambda a: F.get(a, F.size(a) - 1)["s"]
    rows = m.withColumn("x", F.explode_outer(F.transform("_x", lambda x: F.struct(x["s"].alias("obx"), last(before(x["i"])).alias("obr")))))
    rows = rows.withColumns({"OBX": F.col("x.obx"), "OBR": F.coalesce(F.col("x.obr"), F.when(F.col("x").isNull(), last(F.col("_r"))))}).drop("_x", "_r", "x")
    cols = [_field(F.col(t), i, k).alias(n) for n, (t, i, k) in POSITIONS.items()]
    priority = F.when(F.col("OBR").isNotNull(), F.when(_field(F.col("OBR"), 5, None) == "S", "STAT").otherwise("Routine"))
    result_ts = F.coalesce(_field(F.col("OBX"), 14, None), _field(F.col("OBR"), 22, None))
    error = F.when(F.col("MSH").isNotNull() & F.col("OBX").isNull(), F.lit(NO_RESULT))
    return rows.select(*keep, "message_no", *cols, priority.alias("priority"), result_ts.alias("result_ts"), error.alias("parse_error"))


def wire_ts(c: Column | str) -> Column:
    """Timestamp from 14, 12 or 8 digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in ("yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyyMMdd")])


def typed_results(parsed: DataFrame) -> DataFrame:
    """Times as timestamps; a numeric value only for numeric results, text only for the others; the critical flag."""
    out = parsed.withColumns({c: wire_ts(c) for c in ("message_ts", "order_ts", "collect_ts", "result_ts")})
    num = F.col("value_type") == "NM"
    return out.withColumns({
        "result_value_numeric": F.when(num, F.col("result_value").try_cast("decimal(18,4)")),
        "result_value_text": F.when(~num, F.col("result_value")),
        "is_critical": F.coalesce(F.col("abnormal_flag").isin("HH", "LL", "AA"), F.lit(False)),
    })


def check_results(parsed: DataFrame, max_error_pct: float = 2.0) -> dict:
    """Counts in one aggregate; raises on no rows at all or on too many parse errors."""
    no_code = F.col("loinc_code").isNull() & F.col("parse_error").isNull()
    r = parsed.agg(F.count("*").alias("rows"), F.count("parse_error").alias("errors"), F.count_if(no_code).alias("no_code"), F.count_if(F.col("encounter_id").isNull()).alias("no_encounter")).first().asDict()
    if not r["rows"]:
        raise QualityGateError("no result rows were parsed")
    if r["errors"] * 100.0 / r["rows"] > max_error_pct:
        raise QualityGateError(f"{r['errors']} of {r['rows']} rows have parse errors")
    return r
