"""Conversions of the legacy dialect: text that doesn't parse gives null, formats are small numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a format in the ETL's notation, and Spark's.
PARTS = (("CCYY", "yyyy"), ("YY", "yy"), ("DD", "dd"), ("D", "d"), ("MM", "MM"), ("M", "M"), ("hh", "HH"), ("h", "H"), ("mm", "mm"), ("ss", "ss"), ("fff", "SSS"))


def spark_format(pattern: str) -> str:
    out, at = "", 0
    while at < len(pattern):
        for ours, theirs in PARTS:
            if pattern.startswith(ours, at):
                out, at = out + theirs, at + len(ours)
                break
        else:
            out, at = out + (pattern[at] if not pattern[at].isalpha() else f"'{pattern[at]}'"), at + 1
    return out


def str2int(s: Column) -> Column:
    return F.trim(s).try_cast("int")


def str2bigint(s: Column) -> Column:
    return F.trim(s).try_cast("bigint")


def str2real(s: Column, decimal: str = ".") -> Column:
    return F.replace(F.trim(s), F.lit(decimal), F.lit(".")).try_cast("double")


def str2money(s: Column) -> Column:
    """Comma or point before the cents; blanks between thousands."""
    plain = F.regexp_replace(F.regexp_replace(s, r"[\s ]", ""), ",-?$", "")
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("decimal(15,2)")


def str2date(s: Column, pattern: str = "DD.MM.CCYY") -> Column:
    parsed = F.try_to_date(F.trim(s), spark_format(pattern))
    return F.coalesce(parsed, F.try_to_date(F.trim(s), spark_format(pattern.replace("DD", "D").replace("MM", "M")))) if pattern == "DD.MM.CCYY" else parsed


def str2time(s: Column) -> Column:
    """h:mm[:ss[.fff]] as milliseconds of the day."""
    part = lambda n: F.coalesce(F.nullif(F.regexp_extract(s, r"^\s*(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,3}))?)?\s*$", n), F.lit("")), F.lit("0")).cast("int")
    fraction = F.rpad(F.regexp_extract(s, r"^\s*(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,3}))?)?\s*$", 4), 3, "0").cast("int")
    good = s.rlike(r"^\s*\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,3})?)?\s*$") & (part(1) < 24) & (part(2) < 60) & (part(3) < 60)
    return F.when(good, ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + fraction)


def str2timestamp(s: Column, pattern: str = "DD.MM.CCYY hh:mm:ss") -> Column:
    return F.try_to_timestamp(F.trim(s), F.lit(spark_format(pattern))).cast("timestamp_ntz")


def str2bool(s: Column, true: str = "TRUE", false: str = "FALSE") -> Column:
    up = F.upper(F.trim(s))
    return F.when(up == true.upper(), True).when(up == false.upper(), False)


def int2str(n: Column) -> Column:
    return n.cast("string")


def real2str(x: Column, precision: int) -> Column:
    """0 or more: exponential with so many decimals; below 0: fixed; 100 off from that: with thousands separators."""
    if precision >= 0:
        return F.format_string(f"%.{precision}e", x)
    decimals = -precision
    return F.format_number(x, decimals - 100) if decimals >= 100 else F.format_string(f"%.{decimals}f", x)


def money2str(x: Column, form: int = 1) -> Column:
    """0: decimal comma, ``,-`` for whole amounts; 1: decimal point; else with thousands separators."""
    fixed = F.format_string("%.2f", x.cast("double"))
    if form == 0:
        return F.regexp_replace(F.replace(fixed, F.lit("."), F.lit(",")), ",00$", ",-")
    return fixed if form == 1 else F.format_number(x, 2)


def date2str(d: Column, form: int = 1) -> Column:
    """0: d.m.; 1: d.m.yyyy; 2 and 3: with the month's name, short or long; 6: yyyy-mm-dd; else the session's."""
    forms = {0: "d.M.", 1: "d.M.yyyy", 2: "d. MMM yyyy", 3: "d. MMMM yyyy"}
    return F.date_format(d, forms.get(form, "yyyy-MM-dd"))


def time2str(t: Column, form: int = 1) -> Column:
    """0: h:mm; 1: with seconds; 2: with milliseconds."""
    h, m, s = F.floor(t / 3_600_000).cast("int"), (F.floor(t / 60_000) % 60).cast("int"), (F.floor(t / 1000) % 60).cast("int")
    if form == 0:
        return F.format_string("%02d:%02d", h, m)
    return F.format_string("%02d:%02d:%02d", h, m, s) if form == 1 else F.format_string("%02d:%02d:%02d.%03d", h, m, s, (t % 1000).cast("int"))


def timestamp2str(ts: Column, form: int = 1) -> Column:
    return F.date_format(ts, "d.M.yyyy HH:mm:ss" if form == 1 else "yyyy-MM-dd HH:mm:ss")


def bool2str(b: Column, true: str = "TRUE", false: str = "FALSE") -> Column:
    return F.when(b, true).when(~b, false)
