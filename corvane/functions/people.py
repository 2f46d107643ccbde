"""Author names and dates of scholarly records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Version dates look like "Mon, 2 Apr 2007 19:18:42 GMT".
WEEKDAY = r"^[A-Za-z]{3},\s*"
CREATED_FORMAT = "d MMM yyyy HH:mm:ss z"


def short_name(parts: Column) -> Column:
    """Surname and first names."""
    return F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))


def long_name(parts: Column) -> Column:
    """All parts, suffix included."""
    return F.concat_ws(" ", parts)


def created_year(created: Column) -> Column:
    """Year of an RFC-822 date; null where the text is no such date."""
    stamp = F.try_to_timestamp(F.regexp_replace(created, WEEKDAY, ""), F.lit(CREATED_FORMAT))
    return F.year(stamp)


def first_version_year(versions: Column) -> Column:
    return created_year(F.get(versions, F.lit(0))["created"])


def year_prefix(iso_date: Column) -> Column:
    return F.when(F.length(iso_date) >= 4, F.substring(iso_date, 1, 4))
