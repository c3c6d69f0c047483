"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions.climate import col

# Thai month names, January to December.
THAI_MONTHS_SHORT = "ม.ค. ก.พ. มี.ค. เม.ย. พ.ค. มิ.ย. ก.ค. ส.ค. ก.ย. ต.ค. พ.ย. ธ.ค.".split()
THAI_MONTHS_FULL = (
    "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม"
).split()
BUDDHIST_OFFSET = 543


def be_to_ce(year) -> Column:
    return col(year) - BUDDHIST_OFFSET


def ce_to_be(year) -> Column:
    return col(year) + BUDDHIST_OFFSET


def thai_date(c) -> Column:
    """ISO text, or day-month-year with Thai or numeric months and 2- or 4-digit years of either era."""
    text = F.trim(col(c))
    split = F.split(text, r"[-/\s]+")
    parts = [F.get(split, F.lit(i)) for i in range(3)]
    pairs = []
    for names in (THAI_MONTHS_SHORT, THAI_MONTHS_FULL):
        for number, name in enumerate(names, 1):
            pairs += [F.lit(name), F.lit(number)]
    month = F.coalesce(F.element_at(F.create_map(*pairs), parts[1]), parts[1].try_cast("int"))
    year = parts[2].try_cast("int")
    year = F.when(year < 100, year + 2500).otherwise(year)
    year = F.when(year > 2400, year - BUDDHIST_OFFSET).otherwise(year)
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    return (
        F.when(iso, F.substring(text, 1, 10).try_cast("date"))
        .when(F.size(split) == 3, _checked_date(year, month, parts[0].try_cast("int")))
    )


def _checked_date(year, month, day) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
                       F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))


def excel_serial(c) -> Column:
    """Spreadsheet serial day to a timestamp, to the microsecond."""
    micros = F.round(col(c) * F.lit(86_400_000_000.0)).cast("long") - F.lit(25_569 * 86_400_000_000)
    return F.timestamp_micros(micros)


def serial_error_seconds(serial, instant) -> Column:
    return F.abs(F.unix_micros(excel_serial(serial)) - F.unix_micros(col(instant).cast("timestamp"))) / 1e6


def season_bounds(year, month) -> tuple[Column, Column]:
    """First and last day of the three-month season centred on a month, across year ends."""
    centre = F.make_date(col(year), col(month), F.lit(1))
    return F.add_months(centre, -1), F.last_day(F.add_months(centre, 1))


def completed_key(day) -> tuple[Column, Column]:
    """Year and centre month of the latest season that ended before the month of ``day``."""
    back = F.add_months(F.trunc(col(day), "month"), -2)
    return F.year(back), F.month(back)


def month_days(year, month) -> Column:
    first = F.make_date(col(year), col(month), F.lit(1))
    return F.sequence(first, F.last_day(first))


def bloom_range(year, month, min_age, max_age) -> tuple[Column, Column]:
    first = F.make_date(col(year), col(month), F.lit(1))
    return F.date_sub(first, max_age), F.date_sub(F.last_day(first), min_age)


def issue_date(anchor, year, lead) -> Column:
    """``anchor`` is text MM-DD."""
    day = F.make_date(col(year), F.substring(col(anchor), 1, 2).cast("int"), F.substring(col(anchor), 4, 2).cast("int"))
    return F.date_sub(day, lead if isinstance(lead, int) else col(lead))


def to_local(c, zone: str) -> Column:
    return F.from_utc_timestamp(col(c), zone)


def local_day(c, zone: str) -> Column:
    return F.to_date(to_local(c, zone))


def day_number(c) -> Column:
    return F.unix_date(col(c))
