"""X12 claims (837P) and remittances (835) to rows, in Spark expressions only.

A file is split by its own delimiters at the first segment of every claim. Each such part is a
small array of segments: what stands before the next claim's first segment is the next claim's
context, so a running window over the parts of a file, not over its segments, finds what held
at each claim, and a claim never takes over the provider, subscriber or payer of the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.scalar import compact_date, days_between, denied_amount
from lamina.operators.quality import QualityGateError

#: characters of the interchange header; shorter contents are no interchange (fixed value)
HEADER = 106
NO_LINES = "Claim has no service lines"


def split_segments(files: DataFrame, content: str = "content", file: str = "file") -> DataFrame:
    """``file, pos, e`` (elements) of every non-blank segment. Element separator: 4th character; terminator: 106th."""
    t = F.col(content)
    x = files.filter(F.length(t) >= HEADER).select(F.col(file).alias("file"), t.alias("_t"), F.substring(t, 4, 1).alias("_sep"), F.substring(t, HEADER, 1).alias("_end"))
    segs = F.split("_t", F.concat(F.lit("\\Q"), F.col("_end"), F.lit("\\E")))
    x = x.select("file", "_sep", F.posexplode(segs).alias("pos", "_s")).withColumn("_s", F.regexp_replace("_s", "[\r\n]", "")).filter(F.trim("_s") != "")
    return x.select("file", "pos", F.split("_s", F.concat(F.lit("\\Q"), F.col("_sep"), F.lit("\\E"))).alias("e"))


def _at(e: Column, i: int | Column) -> Column:
    """Element of a segment, null if blank."""
    return F.nullif(F.get(e, F.lit(i) if isinstance(i, int) else i), F.lit(""))


def _is(tag: str, qualifier: str | None = None) -> Callable[[Column], Column]:
    """Test of a segment by its tag and first element."""
    return lambda e: (F.get(e, F.lit(0)) == tag) & (F.lit(True) if qualifier is None else F.coalesce(F.get(e, F.lit(1)) == qualifier, F.lit(False)))


def _parts(files: DataFrame, content: str, file: str, tag: str) -> DataFrame:
    """``file, claim_no, segs``: the segments from each ``tag`` to the next one; part 0 is what comes before the first."""
    t = F.col(content)
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    x = files.filter(F.length(t) >= HEADER).select(F.col(file).alias("file"), t.alias("_t"), quoted(F.substring(t, 4, 1)).alias("_sep"), quoted(F.substring(t, HEADER, 1)).alias("_end"))
    cut = F.concat(F.col("_end"), F.lit(f"[\r\n]*(?={tag}(?:"), F.col("_sep"), F.lit("|"), F.col("_end"), F.lit("))"))
    x = x.select("file", "_sep", "_end", F.posexplode(F.split("_t", cut)).alias("claim_no", "_p"))
    segs = F.filter(F.transform(F.split("_p", F.col("_end")), lambda s: F.regexp_replace(s, "[\r\n]", "")), lambda s: F.trim(s) != "")
    return x.select("file", "claim_no", F.transform(segs, lambda s: F.split(s, F.col("_sep"))).alias("segs"))


def _in_context(parts: DataFrame, ctx: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]]) -> DataFrame:
    """Claims with the context that held at their first segment: per name the value at the latest segment before it that passes the test."""
    w = Window.partitionBy("file").orderBy("claim_no").rowsBetween(Window.unboundedPreceding, -1)

    def latest(test: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        hit = F.filter("segs", test)
        return F.when(F.size(hit) > 0, F.struct(value(F.get(hit, F.size(hit) - 1)).alias("v")))

    own = parts.withColumns({f"_{n}": latest(*how) for n, how in ctx.items()})
    return own.select("file", "claim_no", "segs", *[F.last(f"_{n}", ignorenulls=True).over(w)["v"].alias(n) for n in ctx]).filter("claim_no > 0")


def _after(c: Column) -> Column:
    """Second component of a composite, the whole value if there is no colon."""
    parts = F.split(c, ":")
    return F.nullif(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(c), F.lit(""))


def _first(test: Callable[[Column], Column]) -> Column:
    """First segment of the part that passes the test."""
    return F.get(F.filter("segs", test), F.lit(0))


def _with_lines(claims: DataFrame) -> DataFrame:
    """A row per service line instead of ``segs``: a line is an LX with the first SV1 before the next LX; a claim without lines stays."""
    last = F.size("segs") - 1
    lx = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(F.get("segs", i), F.lit(0)) == "LX")
    rows = claims.withColumn("_lx", lx).select("*", F.posexplode_outer("_lx").alias("_k", "_i"))
    own = F.slice("segs", F.col("_i") + 1, F.coalesce(F.get("_lx", F.col("_k") + 1), last + 1) - F.col("_i"))
    rows = rows.withColumn("_own", F.when(F.col("_i").isNotNull(), own)).drop("segs", "_lx", "_i")
    rows = rows.select("*", F.get("_own", F.lit(0)).alias("_a"), F.get(F.filter("_own", _is("SV1")), F.lit(0)).alias("_b")).drop("_own")
    a, b = F.col("_a"), F.col("_b")
    return rows.withColumns({"line_no": F.col("_k") + 1, "line_number": _at(a, 1), "service_code": _after(_at(b, 1)), "line_amount": _at(b, 2), "line_units": _at(b, 4)}).drop("_k", "_a", "_b")


def parse_claims(files: DataFrame, content: str = "content", file: str = "file") -> DataFrame:
    """One row per service line; a claim without lines gives one row with ``parse_error``.

    ``claim_no`` and ``line_no`` count claims of the file and lines of the claim. The payer is the one the claim's
    subscriber loop names, else the loop's own payer field, else the one named last. Equal (claim, line, service) rows
    of a file collapse to the first. One shuffle by file serves both windows.
    """
    nth = lambda i: lambda e: _at(e, i)
    trimmed = lambda i: lambda e: F.nullif(F.trim(_at(e, i)), F.lit(""))
    payer, loop = _is("NM1", "PR"), lambda e: _is("NM1", "PR")(e) | _is("SBR")(e)
    ctx = {
        "interchange_control_number": (_is("ISA"), nth(13)), "transaction_set": (_is("ST"), nth(1)), "_sub": (_is("NM1", "41"), nth(9)), "_rec": (_is("NM1", "40"), nth(9)), "_from": (_is("ISA"), trimmed(6)), "_to": (_is("ISA"), trimmed(8)),
        "transaction_date": (_is("BHT"), nth(4)), "billing_provider_npi": (_is("NM1", "85"), nth(9)), "subscriber_member_id": (_is("NM1", "IL"), nth(9)),
        # null from an SBR on until the payer is named
        "_loop": (loop, lambda e: F.when(payer(e), _at(e, 9))), "_sbr": (_is("SBR"), nth(9)), "_named": (lambda e: payer(e) & _at(e, 9).isNotNull(), nth(9)),
    }
    c = _in_context(_parts(files, content, file, "CLM"), ctx)
    clm = F.get("segs", F.lit(0))
    c = c.select(
        "file", "claim_no", "interchange_control_number", "transaction_set", F.coalesce("_sub", "_from").alias("submitter_id"), F.coalesce("_rec", "_to").alias("receiver_id"), "transaction_date", "billing_provider_npi", "subscriber_member_id", F.coalesce("_loop", "_sbr", "_named").alias("payer_id"),
        _at(clm, 1).alias("claim_number"), _at(clm, 2).alias("billed_amount"), F.get(F.split(_at(clm, 5), ":"), F.lit(0)).alias("place_of_service"), _at(_first(_is("DTP", "472")), 3).alias("service_date"), _after(_at(_first(_is("HI")), 1)).alias("primary_diagnosis_code"),
        "segs",
    )
    out = _with_lines(c).withColumn("parse_error", F.when(F.col("line_no").isNull(), F.lit(NO_LINES)))
    rn = F.row_number().over(Window.partitionBy("file", "claim_number", "line_number", "service_code").orderBy("claim_no", "line_no"))
    return out.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def parse_remittances(files: DataFrame, content: str = "content", file: str = "file") -> DataFrame:
    """One row per claim payment with every triple of every CAS in ``adjustments``.

    ``adjustment_group``, ``adjustment_reason`` and ``adjustment_amount`` are the first triple; amounts of the claim
    itself are never repeated.
    """
    nth = lambda i: lambda e: _at(e, i)
    ctx = {"interchange_control_number": (_is("ISA"), nth(13)), "check_or_eft_number": (_is("TRN"), nth(2)), "payment_method": (_is("BPR"), nth(4)), "payment_amount": (_is("BPR"), nth(2)), "payment_date": (_is("BPR"), nth(16)), "payer_name": (_is("N1", "PR"), nth(2))}
    c = _in_context(_parts(files, content, file, "CLP"), ctx)
    clp = F.get("segs", F.lit(0))
    ks = lambda e: F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size(e) - 3) / 3).cast("int")))
    triple = lambda e: lambda k: F.struct(_at(e, 1).alias("group"), _at(e, 2 + k * 3).alias("reason"), F.get(e, 3 + k * 3).try_cast("decimal(18,2)").alias("amount"))
    adjusted = F.flatten(F.transform(F.filter("segs", _is("CAS")), lambda e: F.filter(F.transform(ks(e), triple(e)), lambda t: t["reason"].isNotNull())))
    out = c.select(
        "file", "claim_no", *ctx, _at(clp, 1).alias("claim_number"), _at(clp, 2).alias("claim_status_code"), _at(clp, 3).alias("billed_amount"), _at(clp, 4).alias("paid_amount"), _at(clp, 5).alias("patient_responsibility"), adjusted.alias("adjustments"),
    )
    one = F.get("adjustments", F.lit(0))
    return out.withColumns({"adjustment_group": one["group"], "adjustment_reason": one["reason"], "adjustment_amount": one["amount"]})


def check_claims(parsed: DataFrame, files: int) -> int:
    """Rows; raises when files gave no rows or a row lacks its claim number."""
    r = parsed.agg(F.count("*").alias("n"), F.count_if(F.col("claim_number").isNull()).alias("missing")).first()
    if files and not r["n"]:
        raise QualityGateError(f"{files} files gave no rows")
    if r["missing"]:
        raise QualityGateError(f"{r['missing']} rows without claim number")
    return r["n"]


def unmatched_remittances(remits: DataFrame, claims: DataFrame) -> DataFrame:
    """Claim numbers that were paid or refused but never submitted."""
    return remits.select("claim_number").distinct().join(claims.select("claim_number").distinct(), "claim_number", "left_anti")


def reconcile_remittances(remits: DataFrame, claims: DataFrame, warn_pct: float = 5.0) -> DataFrame:
    """One row ``remitted, unmatched, unmatched_pct, is_warning`` over distinct claim numbers."""
    paid = remits.filter("claim_number is not null").select("claim_number").distinct()
    sent = claims.select(F.col("claim_number").alias("_c")).filter("_c is not null").distinct()
    both = paid.join(sent, F.col("claim_number") == F.col("_c"), "left").agg(F.count("*").alias("remitted"), F.count_if(F.col("_c").isNull()).alias("unmatched"))
    pct = F.coalesce(F.round(F.try_divide(F.col("unmatched") * 100.0, F.col("remitted")), 4), F.lit(0.0))
    return both.withColumn("unmatched_pct", pct).withColumn("is_warning", F.col("unmatched_pct") > warn_pct)


#: claim status codes of approved and of refused claims (fixed values)
APPROVED, REFUSED = ("1", "2"), "4"


def claims_with_payment(claims: DataFrame, remits: DataFrame) -> DataFrame:
    """Claim headers with line totals, left-joined with their remittances; reloaded files count once.

    Header values are those of the claim's first row by (file, claim, line) that has one; a claim without lines keeps its
    header and has the bill of its own segment. Of a line or payment that several files hold, the first file's counts.
    """
    dec = lambda c: F.col(c).try_cast("decimal(18,2)")
    place = F.struct("file", "claim_no", F.coalesce("line_no", F.lit(0)).alias("line_no"))
    head_cols = ("payer_id", "subscriber_member_id", "billing_provider_npi", "primary_diagnosis_code", "service_date", "transaction_date", "billed_amount")
    line_key = ["claim_number", "line_number", "service_code"]
    rows = claims.groupBy(*line_key).agg(F.min(F.struct(place.alias("p"), "line_no", "line_amount", *head_cols)).alias("r")).select(*line_key, "r.*")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("p", F.col(c).alias("v"))))["v"]
    head = rows.groupBy("claim_number").agg(
        *[first(c).alias(c) for c in head_cols], F.sum(F.when(F.col("line_no").isNotNull(), dec("line_amount"))).alias("line_total"), F.count("line_no").alias("line_count"),
    ).withColumnsRenamed({"subscriber_member_id": "patient_source_id", "billing_provider_npi": "hospital_id", "billed_amount": "_bill", "transaction_date": "submission_date"})
    pay_key = ["claim_number", "check_or_eft_number"]
    pay_cols = ("claim_status_code", "payment_date", "paid_amount", "patient_responsibility", "adjustments", "adjustment_reason")
    once = remits.groupBy(*pay_key).agg(F.min(F.struct("file", "claim_no", *pay_cols)).alias("r")).select(*pay_key, "r.*").withColumn("p", F.struct("file", "claim_no"))
    adjusted = F.aggregate("adjustments", F.lit(0).cast("decimal(18,2)"), lambda a, t: (a + F.coalesce(t["amount"], F.lit(0))).cast("decimal(18,2)"))
    r = once.groupBy("claim_number").agg(
        first("claim_status_code").alias("claim_status_code"), first("payment_date").alias("payment_date"), first("adjustment_reason").alias("denial_reason_code"),
        F.sum(dec("paid_amount")).alias("paid_amount"), F.sum(dec("patient_responsibility")).alias("patient_responsibility"), F.sum(adjusted).alias("adjustment_amount"),
    )
    j = head.join(r, "claim_number", "left")
    j = j.withColumn("billed_amount", F.coalesce("line_total", dec("_bill")).cast("decimal(18,2)")).drop("_bill")
    j = j.withColumns({c: compact_date(c) for c in ("service_date", "submission_date", "payment_date")})
    status = F.col("claim_status_code")
    yes = lambda c: F.coalesce(c, F.lit(False))
    denied = denied_amount("claim_status_code", "billed_amount", "adjustment_amount").cast("decimal(18,2)")
    j = j.withColumns({"is_adjudicated": status.isNotNull(), "is_approved": yes(status.isin(*APPROVED)), "is_denied": yes(status == REFUSED), "denied_amount": denied, "days_to_payment": days_between("submission_date", "payment_date")})
    # what was billed and not denied counts as approved, once a claim is decided
    return j.withColumn("approved_amount", F.when(F.col("is_adjudicated"), (F.col("billed_amount") - F.col("denied_amount")).cast("decimal(18,2)")))
