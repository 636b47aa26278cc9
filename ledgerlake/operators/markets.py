"""What a market's rules add to companies and facts: identity, currency, statement of a concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.money import currency_of

#: The currency of a market's facts where neither fact nor filing names one.
DEFAULT_CURRENCY = {"JP": "JPY", "KR": "KRW", "US": "USD"}
#: Parts of a US concept's letters and digits that place it in a statement, in this order.
US_STATEMENTS = (
    ("balance_sheet", ("assets", "liabilities", "stockholdersequity", "equity")),
    ("income_statement", ("revenue", "salesrevenue", "netincomeloss", "operatingincomeloss", "grossprofit")),
    ("cash_flow_statement", ("netcashprovidedbyusedinoperatingactivities", "cashandcashequivalents", "paymentsforproperty")),
)


def _present(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def hk_code(value: Column) -> Column:
    """Digits of a code filled to five; without digits the code itself; null where nothing is left."""
    text = F.regexp_replace(F.upper(F.trim(value)), r"\.HK$", "")
    text = F.regexp_replace(text, "^HK", "")
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits == "", _present(text)).otherwise(F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))


def company_id(market: Column, current: Column, code: Column, country: Column | None = None, ticker: Column | None = None) -> Column:
    """A company's id by its market's own code: HK stock, JP EDINET, KR corporation, US CIK, EU the first of LEI, ISIN and
    ticker. The id it has stays where there is no code, and, in HK and EU, where it marks a fixture."""
    none = F.lit(None).cast("string")
    code, fixture = _present(code), F.coalesce(F.startswith(F.upper(F.trim(current)), F.concat(market, F.lit(":FIXTURE:"))), F.lit(False))
    place = F.upper(F.coalesce(_present(country if country is not None else none), F.lit("EU")))
    short = F.upper(F.coalesce(_present(ticker if ticker is not None else none), code))
    cik = F.when(F.length(code) < 10, F.lpad(code, 10, "0")).otherwise(code)
    made = (
        F.when(market == "HK", F.when(~fixture, F.concat(F.lit("HK:"), hk_code(code))))
        .when(market.isin("JP", "KR"), F.concat_ws(":", market, F.when(code.isNotNull(), code)))
        .when(market == "US", F.concat(F.lit("US:CIK"), cik))
        .when(market == "EU", F.when(~fixture, F.concat_ws(":", market, place, short, code)))
    )
    return F.when(code.isNotNull(), F.coalesce(made, current)).otherwise(current)


def reporting_currency(market: Column, stated: Column) -> Column:
    """The filing's own, by its wording or as it stands, else the market's."""
    default = F.lit(None).cast("string")
    for name, currency in DEFAULT_CURRENCY.items():
        default = F.when(market == name, F.lit(currency)).otherwise(default)
    return F.coalesce(currency_of(stated), F.upper(_present(stated)), default)


def fact_currency(currency: Column, unit: Column, reporting: Column) -> Column:
    """The fact's own, else what its unit says, else the filing's."""
    return F.coalesce(_present(currency), currency_of(unit), reporting)


def us_statement(concept: Column, current: Column) -> Column:
    """The statement of a US concept by its letters and digits; the one it has where none fits."""
    key, out = F.regexp_replace(F.lower(concept), "[^a-z0-9]+", ""), current
    for name, parts in reversed(US_STATEMENTS):
        hit = F.contains(key, F.lit(parts[0]))
        for part in parts[1:]:
            hit = hit | F.contains(key, F.lit(part))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def multi_currency(facts: DataFrame, keys: list[str], market: str = "market", currency: str = "fact_currency") -> DataFrame:
    """Adds multi_currency: an EU filing (keys) whose facts name several currencies. The aggregate combines on the map side."""
    per = facts.filter(F.col(market) == "EU").groupBy(*keys).agg((F.min(currency) != F.max(currency)).alias("_several"))
    return facts.join(per, keys, "left").withColumn("multi_currency", F.coalesce("_several", F.lit(False))).drop("_several")


def hk_currencies(filings: DataFrame, statements: DataFrame, items: DataFrame, order: str = "ordinal") -> DataFrame:
    """items (filing_id, statement_id, unit, currency) with fact_currency and reporting_currency, by Hong Kong's precedence.

    A statement's currency is what its unit, title and name say, else its own. A filing reports in the currency that its
    statements say, if they say one and the same; else in the one it declares; else in that of its first item that has one.
    An item's currency is what its unit says, else its own, else its statement's, else its filing's.

    filings: filing_id, currency; statements: filing_id, statement_id, unit, title, name, currency. The aggregates combine on
    the map side; only narrow rows of filings and statements are joined to items."""
    own = lambda c: F.coalesce(currency_of(F.col(c)), F.upper(_present(F.col(c))))
    said = currency_of(F.concat_ws(" ", "unit", "title", "name"))
    s = statements.select("filing_id", "statement_id", said.alias("said"), F.coalesce(said, own("currency")).alias("of_statement"))
    one = F.when(F.min("said") == F.max("said"), F.min("said"))
    f = filings.select("filing_id", own("currency").alias("declared")).join(s.groupBy("filing_id").agg(one.alias("said")), "filing_id", "left")
    f = f.select("filing_id", F.coalesce("said", "declared").alias("of_filing"))
    met = items.join(s.groupBy("filing_id", "statement_id").agg(F.max("of_statement").alias("of_statement")), ["filing_id", "statement_id"], "left").join(f, "filing_id", "left")
    met = met.withColumn("_own", F.coalesce(currency_of(F.col("unit")), own("currency"), "of_statement", "of_filing"))
    first = met.groupBy("filing_id").agg(F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col(order))).alias("_first"))
    met = met.join(first, "filing_id", "left").withColumn("reporting_currency", F.coalesce("of_filing", "_first"))
    return met.withColumn("fact_currency", F.coalesce("_own", "reporting_currency")).drop("_own", "_first", "of_statement", "of_filing")
