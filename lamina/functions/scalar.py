"""Column functions of the cleansing and conforming layer. Pure: Column (or column name) in, Column out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "std_string", "std_postal_code", "std_phone", "parse_birth_date", "plausible_birth_date", "health_card_valid", "age_band", "row_hash_of", "with_row_hash", "token_of",
    "postal_area", "name_sound", "record_uid", "rank_by", "name_similarity", "name_sketch", "names_alike", "minutes_between", "stay_days", "stay_hours", "level_1_to_5", "without_codes", "left_unseen",
    "is_cancelled", "date_key", "time_key", "calendar_columns", "minute_columns", "split_member", "members", "new_batch_id", "cast_columns", "compact_date", "days_between",
    "denied_amount", "sorted_set", "flag", "decimal_text", "AGE_BANDS", "UNKNOWN_KEY", "NOT_APPLICABLE_KEY", "LATE_KEY",
]

UNKNOWN_KEY, NOT_APPLICABLE_KEY, LATE_KEY = -1, -2, -3
#: upper age (exclusive) and label of each band (fixed values)
AGE_BANDS = ((18, "0-17"), (35, "18-34"), (50, "35-49"), (65, "50-64"), (75, "65-74"), (85, "75-84"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _digits(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "")


def std_string(c: Column | str) -> Column:
    """Single blanks, trimmed, upper case; empty becomes null."""
    s = F.upper(F.trim(F.regexp_replace(_col(c), r"\s+", " ")))
    return F.nullif(s, F.lit(""))


def std_postal_code(c: Column | str) -> Column:
    """Letter-digit alternation of six; anything else is null."""
    s = F.upper(F.regexp_replace(_col(c), "[^A-Za-z0-9]", ""))
    return F.when(s.rlike(r"^([A-Z]\d){3}$"), s)


def std_phone(c: Column | str, country_code: str = "+1") -> Column:
    """Ten digits get the country code; eleven must begin with 1; anything else is null."""
    d = _digits(c)
    return F.when(F.length(d) == 10, F.concat(F.lit(country_code), d)).when(d.rlike(r"^1\d{10}$"), F.concat(F.lit("+"), d))


def parse_birth_date(c: Column | str) -> Column:
    """ISO, then day first, then month first: an ambiguous date is read day first."""
    t = F.trim(_col(c))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)).cast("date") for p in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")])


def plausible_birth_date(d: Column | str, as_of: Column) -> Column:
    """Null before 1900 and after ``as_of``."""
    d = _col(d)
    return F.when(d.between(F.lit("1900-01-01").cast("date"), as_of), d)


def health_card_valid(c: Column | str) -> Column:
    """Ten digits whose weighted sum (every other digit doubled, nines cast out) ends in 0; null input is not valid."""
    d = _digits(c)
    nums = F.transform(F.split(F.when(F.length(d) == 10, d), ""), lambda x: F.try_to_number(x, F.lit("9")).cast("int"))
    worth = F.transform(F.filter(nums, lambda x: x.isNotNull()), lambda x, i: F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    total = F.aggregate(worth, F.lit(0), lambda a, x: a + x)
    return F.coalesce(total % 10 == 0, F.lit(False))


def age_band(birth: Column | str, as_of: Column) -> Column:
    years = F.floor(F.months_between(as_of, _col(birth)) / 12)
    out = F.when(years.isNull(), "Unknown")
    for below, label in AGE_BANDS:
        out = out.when(years < below, label)
    return out.otherwise("85+")


def row_hash_of(columns: Iterable[str | Column]) -> Column:
    """SHA-256 over the columns' texts, trimmed and upper case, nulls marked: cosmetic differences do not count, positions do."""
    # the marks of null and of a column end are fixed values
    parts = [F.coalesce(F.upper(F.trim(_col(c).cast("string"))), F.lit("<NULL>")) for c in columns]
    return F.sha2(F.concat_ws("||", *parts), 256)


def with_row_hash(df: DataFrame, columns: Iterable[str], out: str = "_row_hash") -> DataFrame:
    return df.withColumn(out, row_hash_of(columns))


def token_of(c: Column | str, salt: str) -> Column:
    """Salted one-way token of an identifier; null stays null. The salt has no default on purpose."""
    return F.sha2(F.concat(F.upper(F.trim(_col(c))), F.lit(salt)), 256)


def postal_area(c: Column | str) -> Column:
    return F.substring(_col(c), 1, 3)


def name_sound(c: Column | str) -> Column:
    return F.soundex(F.coalesce(_col(c), F.lit("")))


def record_uid(system: str, key: Column | str) -> Column:
    """``SYSTEM|key``; a null key gives null, not a bare system name."""
    return F.concat(F.lit(f"{system}|"), _col(key).cast("string"))


def rank_by(c: Column | str, ranks: Mapping[str, int], default: int = 99) -> Column:
    """Trust rank of a source through a map literal."""
    m = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _col(c)), F.lit(default))


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edits / longest length, where lengths under five count as five."""
    a, b = _col(a), _col(b)
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(5))


def name_sketch(v: Column | str, least: float) -> Column:
    """64 bits for :func:`names_alike`, of which an edit changes few: how many edits the name's own length allows (bits 0-3, at most 15), which characters (4-15) and which two in a row (16-63) it has an odd number of."""
    v = _col(v)
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    one = lambda i: bit(4 + F.ascii(F.substring(v, i, F.lit(1))) % 12)
    two = lambda i: bit(16 + F.pmod(F.xxhash64(F.substring(v, i, F.lit(2))), F.lit(48)))
    edits = F.least(F.floor(F.lit(1 - least + 1e-6) * F.greatest(F.length(v), F.lit(5))), F.lit(15)).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), edits, lambda bits, i: bits.bitwiseXOR(one(i)).bitwiseXOR(two(i)))


def names_alike(a: Column | str, b: Column | str, least: float, sketches: tuple[Column, Column] | None = None) -> Column:
    """``name_similarity(a, b) >= least``, counting edits no further than that, and with a :func:`name_sketch` of either only where they may be few enough."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b), F.lit(5))
    edits = F.call_function("levenshtein", a, b, F.ceil(F.lit(1 - least) * longest).cast("int"))  # -1: more than that
    alike = (edits >= 0) & (1 - edits / longest >= least)
    if sketches is not None:
        # an edit takes away and adds one character and two pairs of them at most
        most = F.greatest(*[s.bitwiseAND(F.lit(15).cast("long")) for s in sketches])
        bits = lambda mask: F.bit_count(sketches[0].bitwiseXOR(sketches[1]).bitwiseAND(F.lit(mask).cast("long")))
        alike = (bits(~0xFFFF) <= 4 * most) & (bits(0xFFF0) <= 2 * most) & alike
    return (a == b) | alike


def minutes_between(a: Column | str, b: Column | str) -> Column:
    """Minutes from a to b; null where either is null or b comes first."""
    s = _col(b).cast("timestamp").cast("long") - _col(a).cast("timestamp").cast("long")
    return F.when(s >= 0, s.cast("double") / 60.0)


def stay_days(start: Column | str, end: Column | str) -> Column:
    """Whole days, one at least; null while open or when the end precedes the start."""
    n = F.datediff(_col(end), _col(start))
    return F.when(n >= 0, F.greatest(n, F.lit(1)))


def stay_hours(start: Column | str, end: Column | str) -> Column:
    return (_col(end).cast("timestamp").cast("long") - _col(start).cast("timestamp").cast("long")).cast("double") / 3600.0


def level_1_to_5(c: Column | str) -> Column:
    n = _col(c).try_cast("int")
    return F.when(n.between(1, 5), n)


def without_codes(c: Column | str, codes: Iterable[str]) -> Column:
    """Null for placeholder codes."""
    c = _col(c)
    return F.when(~c.isin(*codes), c)


def left_unseen(seen: Column | str, left: Column | str) -> Column:
    return _col(seen).isNull() & _col(left).isNotNull()


def is_cancelled(status: Column | str) -> Column:
    return _col(status).startswith("CANCELLED")


def date_key(c: Column | str) -> Column:
    """yyyyMMdd as int; null is the unknown member."""
    return F.coalesce(F.date_format(_col(c), "yyyyMMdd").cast("int"), F.lit(UNKNOWN_KEY))


def time_key(c: Column | str) -> Column:
    """Minute of the day; null is the unknown member."""
    return F.coalesce(F.hour(_col(c)) * 60 + F.minute(_col(c)), F.lit(UNKNOWN_KEY))


def calendar_columns(d: Column | str, fiscal_start_month: int = 4) -> dict[str, Column]:
    """Calendar attributes of a date; the fiscal year is named by the year it begins in."""
    d = _col(d)
    back = F.add_months(d, -(fiscal_start_month - 1))
    return {
        "date_key": date_key(d), "full_date": d, "day_of_week": F.dayofweek(d), "day_name": F.date_format(d, "EEEE"), "is_weekend": F.dayofweek(d).isin(1, 7),
        "week_start": F.date_trunc("week", d).cast("date"), "month_number": F.month(d), "month_name": F.date_format(d, "MMMM"), "quarter_number": F.quarter(d), "calendar_year": F.year(d),
        "fiscal_year": F.year(back), "fiscal_quarter": F.quarter(back), "fiscal_period": F.month(back),
    }


def minute_columns(m: Column | str) -> dict[str, Column]:
    """Attributes of a minute of the day."""
    m = _col(m)
    h = F.floor(m / 60).cast("int")
    clock = F.concat_ws(":", F.lpad(h.cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))
    return {"time_key": m.cast("int"), "hour_number": h, "minute_number": (m % 60).cast("int"), "clock": clock, "shift_name": F.when(h.between(7, 14), "Day").when(h.between(15, 22), "Evening").otherwise("Night")}


def split_member(c: Column | str, sep: str, i: int) -> Column:
    """The i-th part (from 0) or null."""
    return F.get(F.split(_col(c), sep), F.lit(i))


def members(c: Column | str, sep: str = r"\|") -> Column:
    """Generator of the parts of a list text."""
    return F.explode(F.split(_col(c), sep))


def new_batch_id(system: str, entity: str, now: datetime) -> str:
    return f"{system}_{entity}_{now:%Y%m%dT%H%M%S}"


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Tolerant casts: unreadable texts become null, thousands separators of numbers are dropped."""
    number = ("int", "bigint", "smallint", "double", "float", "decimal")

    def one(name: str, kind: str) -> Column:
        c = F.trim(F.col(name).cast("string"))
        return (F.replace(c, F.lit(","), F.lit("")) if kind.startswith(number) else c).try_cast(kind)

    return df.withColumns({n: one(n, k) for n, k in types.items()})


def compact_date(c: Column | str) -> Column:
    return F.try_to_timestamp(_col(c), F.lit("yyyyMMdd")).cast("date")


def days_between(a: Column | str, b: Column | str) -> Column:
    return F.datediff(_col(b), _col(a))


def denied_amount(status: Column | str, billed: Column | str, adjustment: Column | str) -> Column:
    """All of the bill for a refused claim (status 4), else the adjustment."""
    return F.when(_col(status) == "4", _col(billed)).otherwise(F.coalesce(_col(adjustment), F.lit(0)))


def sorted_set(c: Column | str, sep: str = ",") -> Column:
    """Aggregate: distinct values, sorted, as one text."""
    return F.concat_ws(sep, F.sort_array(F.collect_set(_col(c))))


def flag(c: Column | str) -> Column:
    return _col(c) == "1"


def decimal_text(c: Column | str, precision: int = 18, scale: int = 2) -> Column:
    """Decimal from text; thousands separators dropped, unreadable is null."""
    return F.replace(F.trim(_col(c)), F.lit(","), F.lit("")).try_cast(f"decimal({precision},{scale})")
