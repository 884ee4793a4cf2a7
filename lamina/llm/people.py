"""Person attributes of the two patient sources in one notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import table

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKE_FROM = "АВЕКМНОРСТУХІЈЅавекмнорстухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορ"
LOOKALIKE_TO = "ABEKMHOPCTYXIJSABEKMHOPCTYXIJSABEZHIKMNOPTYXAOP"
ACCENT_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
ACCENT_TO = "AAAAAACEEEEIIIINOOOOOUUUUY"
#: Name texts that stand for "unknown" (fixed values).
UNKNOWN_WORDS = ("UNKNOWN", "NA", "NONE", "NULL", "NOTKNOWN", "ANONYMOUS", "TEST")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def one_digit(c: Column) -> Column:
    """Is one character repeated throughout?"""
    return F.length(F.replace(c, F.substring(c, 1, 1), F.lit(""))) == 0


def _some(d: Column) -> Column:
    return F.when((d != "") & ~one_digit(d), d)


def card(c: Column) -> Column:
    """Ten digits with a valid mod-10 check digit, not one digit throughout; separators do not matter."""
    shape = F.regexp_replace(c, r"[\s\x{00A0}.\-/_]", "")
    d = F.when(shape.rlike("^[0-9]{10}$"), shape)
    total = None
    for i in range(10):
        x = F.substring(d, i + 1, 1).cast("int")
        if i % 2 == 0:
            x = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        total = x if total is None else total + x
    return F.when((total % 10 == 0) & ~one_digit(d), d)


def day(c: Column, day_first: bool) -> Column:
    """An existing date from 1900 on that is not in the future, from any of the notations in use."""
    t = F.trim(c)
    slash = F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(t, F.lit("dd/MM/yyyy" if day_first else "MM/dd/yyyy")))
    d = F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))),
        F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd"))),
        slash,
        F.when(t.rlike(r"^\d{2}-[A-Za-z]{3}-\d{4}$"), F.try_to_timestamp(F.initcap(t), F.lit("dd-MMM-yyyy"))),
    ).cast("date")
    return F.when((d >= F.lit("1900-01-01").cast("date")) & (d <= F.current_date()), d)


def postal(c: Column) -> Column:
    s = F.upper(F.regexp_replace(c, r"[\s\x{00A0}.\-/_]", ""))
    return F.when(s.rlike("^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$"), s)


def phone(c: Column) -> Column:
    """Ten digits; eleven beginning with 1 lose it; one digit throughout is nothing."""
    d = F.regexp_replace(c, r"[\s\x{00A0}.\-/_()+]", "")
    d = F.when(d.rlike("^1[0-9]{10}$"), F.substring(d, 2, 10)).when(d.rlike("^[0-9]{10}$"), d)
    return F.when(~one_digit(d), d)


def name(c: Column) -> Column:
    """Upper case Latin letters and single blanks; look-alikes and accents folded; unknowns null."""
    u = F.translate(F.upper(F.translate(c, LOOKALIKE_FROM, LOOKALIKE_TO)), ACCENT_FROM, ACCENT_TO)
    u = F.trim(F.regexp_replace(F.regexp_replace(u, "[^A-Z]+", " "), " +", " "))
    flat = F.replace(u, F.lit(" "), F.lit(""))
    return F.when((u != "") & ~flat.isin(*UNKNOWN_WORDS), u)


def sex(c: Column) -> Column:
    u = F.upper(F.trim(c))
    return F.when(u.isin("F", "FEMALE", "2"), "F").when(u.isin("M", "MALE", "1"), "M")


#: field -> (column in ehr_patient, column in sched_patient)
FIELDS = {
    "given": ("first_name", "given"), "family": ("last_name", "surname"), "dob": ("date_of_birth", "dob"), "sex": ("gender", "sex"),
    "card": ("health_card_number", "health_card"), "postal": ("postal_code", "postal"), "phone": ("primary_phone", "contact_phone"),
}


def _clean(df: DataFrame, side: int, system: str, key: str, at: str) -> DataFrame:
    raw = {f: F.col(cols[side]) for f, cols in FIELDS.items()}
    uid = F.upper(F.regexp_replace(F.col(key), r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""))
    return df.select(
        F.when(uid != "", F.concat(F.lit(f"{system}|"), uid)).alias("uid"), F.lit(system).alias("system"), F.col(at).cast("timestamp").alias("modified"),
        name(raw["given"]).alias("given"), name(raw["family"]).alias("family"), day(raw["dob"], system == "SCHED").alias("dob"), sex(raw["sex"]).alias("sex"),
        card(raw["card"]).alias("card"), postal(raw["postal"]).alias("postal"), phone(raw["phone"]).alias("phone"), _some(digits(raw["card"])).alias("card_digits"),
        F.when(F.upper(raw["postal"]).rlike(r"^\s*[A-Za-z][0-9][A-Za-z]"), F.upper(F.substring(F.trim(raw["postal"]), 1, 3))).alias("fsa"),
        _some(F.when(F.length(digits(raw["phone"])) >= 7, F.right(digits(raw["phone"]), F.lit(7)))).alias("phone7"),
    ).filter("uid is not null")


def records(spark: SparkSession, d: str) -> DataFrame:
    """All rows of both patient sources, cleaned; ``uid`` is ``SYSTEM|id`` in plain spelling."""
    ehr = _clean(table(spark, d, "ehr_patient"), 0, "EHR", "patient_id", "last_modified_ts")
    sched = _clean(table(spark, d, "sched_patient"), 1, "SCHED", "patient_ref", "modified_at")
    return ehr.unionByName(sched)
