"""Scales, currencies and periods of printed amounts. The ladders are ordered: the first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a unit text multiplies by, longest wording first.
SCALES = (
    ("100 million", 1e8), ("hundred million", 1e8), ("억원", 1e8), ("억 원", 1e8), ("億円", 1e8),
    ("billion", 1e9), ("十亿", 1e9), ("十億", 1e9),
    ("million", 1e6), ("백만", 1e6), ("百万", 1e6), ("百萬", 1e6),
    ("亿", 1e8), ("億", 1e8), ("억", 1e8),
    ("thousand", 1e3), ("천", 1e3), ("千", 1e3),
    ("万", 1e4), ("萬", 1e4), ("만", 1e4),
)
#: What tells a currency in a unit text.
CURRENCIES = (
    ("hk$", "HKD"), ("hkd", "HKD"), ("港", "HKD"), ("us$", "USD"), ("usd", "USD"), ("美元", "USD"), ("rmb", "CNY"), ("cny", "CNY"), ("人民币", "CNY"), ("人民幣", "CNY"),
    ("eur", "EUR"), ("€", "EUR"), ("欧元", "EUR"), ("gbp", "GBP"), ("£", "GBP"), ("sterling", "GBP"), ("chf", "CHF"), ("swiss franc", "CHF"),
    ("jpy", "JPY"), ("yen", "JPY"), ("日元", "JPY"), ("円", "JPY"), ("krw", "KRW"), ("won", "KRW"), ("韩元", "KRW"), ("韓元", "KRW"), ("원", "KRW"),
    ("元", "CNY"), ("¥", "CNY"), ("$", "USD"),
)


def _ladder(text: Column, steps, default) -> Column:
    low, out = F.lower(text), None
    for key, value in steps:
        out = F.when(low.contains(key), F.lit(value)) if out is None else out.when(low.contains(key), F.lit(value))
    return out.otherwise(F.lit(default))


def scale_of(unit: Column) -> Column:
    return _ladder(unit, SCALES, 1.0)


def currency_of(unit: Column) -> Column:
    return _ladder(unit, CURRENCIES, None)


def duration_bucket(days: Column) -> Column:
    """Quarter, half year, nine months, year by inclusive days."""
    return F.when(days.between(80, 100), "QTD").when(days.between(170, 190), "H1").when(days.between(260, 285), "9M").when(days.between(350, 380), "FY").otherwise("OTHER")


def quarter_end(day: Column) -> Column:
    return F.last_day(F.make_date(F.year(day), F.quarter(day) * 3, F.lit(1)))
