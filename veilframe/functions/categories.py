"""Entity categories: display order, token prefix, tone, marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values, in display order: category, token prefix, tone, marker.
CATEGORIES = (
    ("PERSON", "OSOBA", "yellow", "P"),
    ("PESEL", "PESEL", "red", "#"),
    ("NIP", "NIP", "red", "#"),
    ("REGON", "REGON", "red", "#"),
    ("ID_CARD", "DOWOD", "red", "#"),
    ("PASSPORT", "PASZPORT", "red", "#"),
    ("KRS", "KRS", "red", "#"),
    ("LAND_REGISTER", "KSIEGA_WIECZYSTA", "red", "#"),
    ("LAND_PARCEL", "DZIALKA", "red", "#"),
    ("DRIVING_LICENSE", "PRAWO_JAZDY", "red", "#"),
    ("KSEF", "KSEF", "red", "#"),
    ("CASE_NUMBER", "SYGNATURA", "red", "#"),
    ("ADMIN_CASE", "ZNAK_SPRAWY", "red", "#"),
    ("BANK_ACCOUNT", "RACHUNEK", "red", "#"),
    ("PAYMENT_CARD", "KARTA", "red", "#"),
    ("ADDRESS", "ADRES", "blue", "A"),
    ("GPS", "GPS", "blue", "G"),
    ("COMPANY", "FIRMA", "green", "F"),
    ("PUBLIC_INSTITUTION", "INSTYTUCJA", "gray", "I"),
    ("VEHICLE", "POJAZD", "orange", "V"),
    ("PHONE", "TELEFON", "purple", "@"),
    ("EMAIL", "EMAIL", "purple", "@"),
    ("URL", "URL", "purple", "@"),
    ("IP_ADDRESS", "IP", "purple", "@"),
    ("MAC_ADDRESS", "MAC", "purple", "@"),
    ("API_KEY", "KLUCZ", "purple", "@"),
    ("DATE", "DATA", "gray", "D"),
    ("MONEY", "KWOTA", "gold", "$"),
    ("CUSTOM", "DANE", "pink", "*"),
)
ORDER = {row[0]: k for k, row in enumerate(CATEGORIES)}
DEFAULT_PREFIX, DEFAULT_TONE, DEFAULT_MARKER = "DANE", "gray", "*"


def categories(spark: SparkSession) -> DataFrame:
    """The dimension table, 29 rows: category, ord, prefix, tone, css_class, marker."""
    rows = [(c, k, p, t, "highlight--public-institution" if c == "PUBLIC_INSTITUTION" else f"highlight--{t}", m) for k, (c, p, t, m) in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "category string, ord int, prefix string, tone string, css_class string, marker string")


def _pick(category: Column, column: int, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for row in CATEGORIES for x in (row[0], row[column])])
    return F.coalesce(F.try_element_at(table, category), F.lit(default))


def token_prefix(category: Column) -> Column:
    return _pick(category, 1, DEFAULT_PREFIX)


def category_tone(category: Column) -> Column:
    return _pick(category, 2, DEFAULT_TONE)


def category_marker(category: Column) -> Column:
    return _pick(category, 3, DEFAULT_MARKER)


def category_class(category: Column) -> Column:
    return F.when(category == "PUBLIC_INSTITUTION", "highlight--public-institution").otherwise(F.concat(F.lit("highlight--"), category_tone(category)))


def values_sql() -> str:
    """The dimension as a VALUES list for SQL."""
    return ", ".join(f"('{c}', {k}, '{p}', '{t}')" for k, (c, p, t, _) in enumerate(CATEGORIES))
