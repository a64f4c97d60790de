"""Colombian public-holiday calendar and day types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.functions.columns import let

# Month, day and name of holidays that stay on their date.
FIXED_HOLIDAYS = [
    (1, 1, "Año Nuevo"),
    (5, 1, "Día del Trabajo"),
    (7, 20, "Día de la Independencia"),
    (8, 7, "Batalla de Boyacá"),
    (12, 8, "La Inmaculada Concepción"),
    (12, 25, "Navidad"),
]
# Holidays kept on the first Monday on or after their date.
MONDAY_HOLIDAYS = [
    (1, 6, "Día de los Reyes Magos"),
    (3, 19, "Día de San José"),
    (6, 29, "Día de San Pedro y San Pablo"),
    (8, 15, "La Asunción"),
    (10, 12, "Día de la Raza"),
    (11, 1, "Día de Todos los Santos"),
    (11, 11, "Independencia de Cartagena"),
]
# Days after Easter Sunday.
EASTER_HOLIDAYS = [
    (-3, "Jueves Santo"),
    (-2, "Viernes Santo"),
    (43, "La Ascensión del Señor"),
    (64, "Corpus Christi"),
    (71, "Sagrado Corazón de Jesús"),
]


def _div(a: Column, b: int | Column) -> Column:
    return F.floor(a / b)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by integer arithmetic on the year."""
    golden = year % 19
    century = _div(year, 100)
    epact = (century - _div(century, 4) - _div(8 * century + 13, 25) + 19 * golden + 15) % 30

    def full_moon(e: Column) -> Column:
        return e - _div(e, 28) * (1 - _div(e, 28) * _div(F.lit(29), e + 1) * _div(21 - golden, 11))

    def sunday(moon: Column) -> Column:
        weekday = (year + _div(year, 4) + moon + 2 - century + _div(century, 4)) % 7
        return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), (moon - weekday).cast("int"))

    return let(let(epact, full_moon), sunday)


def holiday_name(date: Column | str) -> Column:
    """Name of the public holiday on ``date``; null on other days, names joined when two coincide."""
    d = F.col(date) if isinstance(date, str) else date
    year = F.year(d)
    fixed = F.create_map(*[F.lit(x) for m, k, name in FIXED_HOLIDAYS for x in (m * 100 + k, name)])
    moving = F.create_map(*[F.lit(x) for n, name in EASTER_HOLIDAYS for x in (n, name)])
    names = [fixed[F.month(d) * 100 + F.dayofmonth(d)], moving[F.datediff(d, easter_sunday(year))]]
    names += [
        F.when((F.weekday(d) == 0) & F.datediff(d, F.make_date(year, F.lit(m), F.lit(k))).between(0, 6), name)
        for m, k, name in MONDAY_HOLIDAYS
    ]
    found = F.array_sort(F.array_compact(F.array(*names)))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def is_holiday(date: Column | str) -> Column:
    return holiday_name(date).isNotNull()


def classify_day(date: Column | str, holiday: Column) -> Column:
    """WD, SA, SU or HO; a holiday overrides the weekday."""
    d = F.col(date) if isinstance(date, str) else date
    return (
        F.when(holiday, "HO").when(F.weekday(d) == 5, "SA").when(F.weekday(d) == 6, "SU").otherwise("WD")
    )


def day_calendar(dates: DataFrame, date: str = "date") -> DataFrame:
    """One row per distinct day: date, day type and holiday name."""
    named = dates.select(date).distinct().withColumn("holiday", holiday_name(date))
    return named.withColumn("date_type", classify_day(date, F.col("holiday").isNotNull()))


def with_day_type(df: DataFrame, ts: str, out: str = "date_type") -> DataFrame:
    """Add the day type. Meant for aggregated rows; the expression needs no join and no shuffle."""
    d = F.to_date(F.col(ts))
    return df.withColumn(out, classify_day(d, is_holiday(d)))


def holidays_between(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Holiday list of whole years, one row per holiday."""
    days = spark.sql(
        f"SELECT explode(sequence(make_date({int(first_year)}, 1, 1), make_date({int(last_year)}, 12, 31))) AS date"
    )
    return days.withColumn("holiday", holiday_name("date")).where("holiday IS NOT NULL")
