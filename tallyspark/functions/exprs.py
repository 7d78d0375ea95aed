"""Pure ``Column -> Column`` functions.  All JVM-side built-ins,
so they stay inside whole-stage codegen; no Python runs per row.

Time is always an explicit ``as_of`` argument, never ``current_date``.
"""

from __future__ import annotations

import datetime as _dt
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_of_lit(as_of: str | _dt.date) -> Column:
    return F.lit(str(as_of)).cast("date")


# --------------------------------------------------------------- null handling
def strip(x: ColumnOrName) -> Column:
    """Python ``str.strip()`` for the usual whitespace."""
    return F.btrim(_c(x), F.lit(" \t\n\r"))


def null_tokens(x: ColumnOrName) -> Column:
    """``nan`` / ``none`` / ``null`` / ``NaT`` / blank -> NULL; otherwise the stripped text."""
    s = strip(_c(x).cast("string"))
    return F.when(F.lower(s).isin(*K.NULL_TOKENS), F.lit(None).cast("string")).otherwise(s)


def blank_to_null(x: ColumnOrName) -> Column:
    s = strip(_c(x).cast("string"))
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def is_blank(x: ColumnOrName) -> Column:
    return null_tokens(x).isNull()


def first_non_blank(*cols: ColumnOrName, default: str | None = None) -> Column:
    parts = [blank_to_null(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts) if len(parts) > 1 else parts[0]


# --------------------------------------------------------------- parsing
# shape of each format: only values of that shape reach the parser (a failed parse is
# an exception inside the JVM, ~100x the cost of a regex test)
_DATE_SHAPES = {"yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
                "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
                "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$"}


#: a time of day after a date, with fraction and zone
_TIME_RE = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*([AaPp][Mm]|Z|[+-]\d{2}:?\d{2})?$"


def parse_date(x: ColumnOrName) -> Column:
    """First format that parses, in the fixed order (d/m before m/d, T3), else a day with the name of its month; NULL
    where none does.  A time of day behind the date is left out."""
    s = null_tokens(x)
    s = F.when(s.contains(":"), F.regexp_replace(s, _TIME_RE, "")).otherwise(s)
    shaped = [F.when(s.rlike(_DATE_SHAPES[f]), F.try_to_timestamp(s, F.lit(f))) for f in K.DATE_FORMATS]
    named = F.when(s.rlike(r"(?i)^\d{1,2}[- ][a-z]{3}[- ]\d{4}$"),
                   F.try_to_timestamp(F.initcap(F.lower(F.translate(s, "-", " "))), F.lit("d MMM yyyy")))
    return F.coalesce(*shaped, named).cast("date")


parse_date_any = parse_date


# numeric text as the casts accept it; a failed cast is an exception inside the JVM, so
# values of another shape never reach the cast
NUM_RE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
SPECIAL_RE = r"(?i)^[+-]?(nan|inf|infinity)$"


def to_double(x: ColumnOrName) -> Column:
    """Strict text -> double (``pd.to_numeric`` shapes: plain, exponent, nan/inf)."""
    s = strip(_c(x).cast("string"))
    return F.when(s.rlike(NUM_RE) | s.rlike(SPECIAL_RE), s.try_cast("double"))


def to_decimal(x: ColumnOrName, dtype: str = "decimal(18,2)") -> Column:
    s = strip(_c(x).cast("string"))
    return F.when(s.rlike(NUM_RE), s.try_cast(dtype))


def parse_amount(x: ColumnOrName) -> Column:
    """Keep digits, '.', '-' and read as decimal(18,2); NULL when that fails (T4 kept)."""
    cleaned = F.regexp_replace(_c(x).cast("string"), r"[^0-9.\-]", "")
    return to_decimal(cleaned)


def amount_inexact(x: ColumnOrName, amount: ColumnOrName) -> Column:
    """Whether a numeric text lost something on its way to ``amount``: digits that its type does not hold, or all."""
    s = strip(_c(x).cast("string"))
    wide = F.when(s.rlike(NUM_RE), s.try_cast("decimal(38,12)"))
    return s.rlike(NUM_RE) & ~F.coalesce(wide == _c(amount).cast("decimal(38,12)"), F.lit(False))


def format_amount(a: ColumnOrName) -> Column:
    """An amount for display: rupee sign, thousands separated, two decimals; ``N/A`` for null."""
    return F.coalesce(F.concat(F.lit("₹"), F.format_number(_c(a), 2)), F.lit("N/A"))


def parse_number_or_zero(x: ColumnOrName) -> Column:
    """Lenient report variant: remove commas, float or 0.0 (``18%`` -> 0, T31)."""
    s = F.replace(strip(_c(x).cast("string")), F.lit(","), F.lit(""))
    return F.coalesce(to_decimal(s), F.lit(0).cast("decimal(18,2)"))


def amount_out_of_range(a: ColumnOrName) -> Column:
    a = _c(a)
    return (a < K.AMOUNT_MIN) | (a > K.AMOUNT_MAX)


def name_date(name: ColumnOrName) -> Column:
    """Date embedded in a file name (``…_2024-01-31.xlsx``)."""
    return F.try_to_timestamp(F.regexp_extract(_c(name), r"(\d{4}-\d{2}-\d{2})", 1),
                              F.lit("yyyy-MM-dd")).cast("date")


# --------------------------------------------------------------- extractors
def extract_gst(*cols: ColumnOrName) -> Column:
    """First GSTIN-shaped value among the given columns (GST-like first, vendor text last)."""
    parts = [F.upper(F.regexp_extract(_c(c).cast("string"), K.GSTIN_RE, 0)) for c in cols]
    return F.coalesce(*[F.when(p != "", p) for p in parts], F.lit(""))


def first_date(*cols: ColumnOrName) -> Column:
    """First parsable date among the columns, in column order."""
    return F.coalesce(*[parse_date(c) for c in cols]) if cols else F.lit(None).cast("date")


def first_text(*cols: ColumnOrName, upper: bool = False, default: str = "") -> Column:
    parts = [null_tokens(c) for c in cols]
    if upper:
        parts = [F.upper(p) for p in parts]
    return F.coalesce(*parts, F.lit(default))


def derive_location(state: ColumnOrName, gst: ColumnOrName) -> Column:
    """State text, else the first two GSTIN characters (a missing GSTIN gives '', T5)."""
    g = null_tokens(gst)
    return F.coalesce(null_tokens(state), F.when(F.length(g) >= 2, F.substring(g, 1, 2)), F.lit(""))


def due_alert(due: ColumnOrName, as_of) -> Column:
    d = _c(due)
    days = F.datediff(d, as_of_lit(as_of))
    return (F.when(d.isNull(), F.lit(""))
             .when(days < 0, F.lit("OVERDUE"))
             .when(days <= K.DUE_ALERT_DAYS, F.lit("YES"))
             .otherwise(F.lit("NO")))


def tax_total(cgst, sgst, igst, vat) -> Column:
    return _c(cgst) + _c(sgst) + _c(igst) + _c(vat)


def tax_type(cgst, sgst, igst, vat) -> Column:
    return (F.when(_c(igst) > 0, F.lit("IGST"))
             .when(_c(cgst) + _c(sgst) > 0, F.lit("GST"))
             .when(_c(vat) > 0, F.lit("VAT"))
             .otherwise(F.lit("")))


def tds_status(raw: ColumnOrName) -> Column:
    r = strip(_c(raw).cast("string"))
    return (F.when(parse_number_or_zero(r) > 0, F.lit("Deducted"))
             .when(r.isNotNull() & ~r.isin("", "0", "0.0"), r)
             .otherwise(F.lit("Not Deducted")))


def clean_creator(name: ColumnOrName, title: bool = True) -> Column:
    """Drop a trailing ``( … )``; null-like -> ``System Generated``; ``initcap`` (T9)."""
    s = strip(F.regexp_replace(F.coalesce(_c(name).cast("string"), F.lit("")), r"\s*\(.*\)$", ""))
    t = F.initcap(s) if title else s
    return F.when((s == "") | F.lower(s).isin(*K.CREATOR_NULL_LIKE), F.lit("System Generated")).otherwise(t)


def valid_email(x: ColumnOrName) -> Column:
    return _c(x).rlike(K.EMAIL_RE)


def gst_result_class(x: ColumnOrName) -> Column:
    s = F.coalesce(_c(x).cast("string"), F.lit(""))
    return (F.when(s.contains("✅"), F.lit("Correct"))
             .when(s.contains("❌"), F.lit("Error"))
             .otherwise(F.lit("Warning")))


def location_head(x: ColumnOrName) -> Column:
    return F.split_part(F.coalesce(_c(x).cast("string"), F.lit("")), F.lit(","), F.lit(1))


# --------------------------------------------------------------- hashing
def invoice_hash(number, vendor, date, gstin, pan, hsn, taxable, total) -> Column:
    """SHA-256 of the 8 history fields joined by '|', defaults '' and '0' (T14 fixed: normalised names)."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit("")) for c in (number, vendor, date, gstin, pan, hsn)]
    parts += [F.coalesce(_c(c).cast("string"), F.lit("0")) for c in (taxable, total)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def row_hash(*cols: ColumnOrName) -> Column:
    """Stable whole-row hash (no session salt, T13)."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(_c(c).cast("string"), F.lit("\u0002")) for c in cols]), 256)


# --------------------------------------------------------------- status
def standardize_status(status: ColumnOrName | None = None, issues: ColumnOrName | None = None,
                       validation_status: ColumnOrName | None = None) -> Column:
    """Status column if present; else derived from issues (blank -> VALID) or the validation
    status; mapped through the fixed map, leading symbols stripped (T22)."""
    if status is not None:
        raw = _c(status).cast("string")
    elif issues is not None:
        raw = F.when(null_tokens(issues).isNull(), F.lit("VALID")).otherwise(F.lit("FLAGGED"))
    elif validation_status is not None:
        raw = _c(validation_status).cast("string")
    else:
        raw = F.lit("UNKNOWN")
    s = F.upper(strip(F.regexp_replace(F.coalesce(raw, F.lit("UNKNOWN")), r"^[^A-Za-z]+", "")))
    m = F.create_map(*[x for kv in K.STATUS_MAP.items() for x in map(F.lit, kv)])
    return F.coalesce(F.try_element_at(m, s), F.lit("UNKNOWN"))


def discrepancies(amount: ColumnOrName, vendor: ColumnOrName) -> Column:
    """Row discrepancy text joined by '; ', NULL when there is none."""
    a = _c(amount)
    v = F.lower(strip(F.coalesce(_c(vendor).cast("string"), F.lit(""))))
    arr = F.array(
        F.when(a.isNull(), F.lit(K.DISC_BAD_AMOUNT)).when(a <= 0, F.lit(K.DISC_NONPOSITIVE)),
        F.when(v.isin("", "nan", "unknown"), F.lit(K.DISC_NO_VENDOR)))
    txt = F.concat_ws("; ", arr)
    return F.when(txt == "", F.lit(None).cast("string")).otherwise(txt)


def pct(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Percentage with 2 decimals, rounded half-up in integer arithmetic (portable)."""
    n, d = _c(num).cast("bigint"), _c(den).cast("bigint")
    bp = F.when(d > 0, F.floor((n * 20000 + d) / (d * 2)))
    return (bp / 100).cast("decimal(9,2)")


def tokens_of(header: str) -> list[str]:
    return [t for t in header.lower().replace("-", "_").replace(" ", "_").split("_") if t]


def header_matches(header: str, tokens: Iterable[str]) -> bool:
    """Token match on '_'-separated header parts (T2 fixed: 'updated' is not 'date')."""
    h = header.lower().replace("-", "_").replace(" ", "_")
    parts = set(tokens_of(h))
    for t in tokens:
        if "_" in t:
            if t in h:
                return True
        elif t in parts:
            return True
    return False
