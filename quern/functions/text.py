"""String functions of the legacy dialect as native column expressions. Positions are 1-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pref(a: Column, b: Column) -> Column:
    """``a`` is a prefix of ``b``."""
    return F.startswith(b, a)


def substr(a: Column, b: Column) -> Column:
    """``a`` occurs in ``b``."""
    return F.contains(b, a)


def strpos(sub: Column, s: Column) -> Column:
    return F.position(sub, s)


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Positions before the first count against the length, as the standard has it."""
    if length is None:
        return F.substring(s, F.greatest(start, F.lit(1)), F.length(s) + 1)
    return F.substring(s, F.greatest(start, F.lit(1)), F.greatest(length + F.least(start - 1, F.lit(0)), F.lit(0)))


def strcopy(s: Column, start: Column, length: Column) -> Column:
    return F.substring(s, F.greatest(start, F.lit(1)), length)


def strinsert(source: Column, into: Column, at: Column) -> Column:
    """``source`` inserted before position ``at``; blanks fill the way to a position beyond the end; 0 changes nothing."""
    head = F.rpad(F.substring(into, F.lit(1), at - 1), at - 1, F.lit(" "))
    return F.when(at <= 0, into).otherwise(F.concat(head, source, F.substring(into, at, F.length(into) + 1)))


def strdelete(s: Column, at: Column, length: Column) -> Column:
    """``length`` characters from position ``at`` on are left out; 0 changes nothing."""
    return F.when(at <= 0, s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.greatest(length, F.lit(0)), F.length(s) + 1)))


def strtrim(s: Column) -> Column:
    return F.trim(s)


def like(s: Column, pattern: str, escape: str | None = None, ignore_case: bool = False) -> Column:
    """LIKE without an escape character unless one is given: a backslash is then an ordinary character."""
    if ignore_case:
        s, pattern = F.lower(s), pattern.lower()
        escape = escape.lower() if escape else None
    if escape is None:
        return F.like(s, F.lit(pattern.replace("\\", "\\\\")))
    return F.like(s, F.lit(pattern), F.lit(escape))


def regexp_like(s: Column, pattern: str, options: str = "") -> Column:
    """Options of the expression: any of i, m, s and x."""
    return s.rlike(f"(?{options}){pattern}" if options else pattern)


def ord_(s: Column) -> Column:
    return F.ascii(s)


def chr_(n: Column) -> Column:
    return F.char(n)
