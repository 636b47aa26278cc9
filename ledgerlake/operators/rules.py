"""Rules as data: each is a row of names, turned into one Column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import bridge


@dataclass(frozen=True)
class Bridge:
    """total = the signed sum of parts. Optional rules are skipped where a part is missing, zeros fill what may be."""

    rule_id: str
    total: str
    parts: tuple[tuple[int, str], ...]
    required: bool = True
    zero_if_missing: tuple[str, ...] = ()
    share: float = 0.005
    least: float = 2.0

    def status(self) -> Column:
        return self.status_of({name: F.col(name) for name in (self.total, *(p for _, p in self.parts))})

    def status_of(self, items: dict[str, Column]) -> Column:
        """The status by the items given; those left out are null."""
        item = lambda name: items.get(name, F.lit(None).cast("decimal(38,6)"))
        term = lambda sign, name: (F.coalesce(item(name), F.lit(0)) if name in self.zero_if_missing else item(name)) * sign
        total = None
        for sign, name in self.parts:
            total = term(sign, name) if total is None else total + term(sign, name)
        return bridge(item(self.total), total, self.required, self.share, self.least)


#: The accounting identities; one wide row holds a filing's canonical items.
BRIDGES = (
    Bridge("balance", "total_assets", ((1, "total_liabilities"), (1, "temporary_equity"), (1, "total_equity")), zero_if_missing=("temporary_equity",)),
    Bridge("balance_total", "total_assets", ((1, "liabilities_and_equity"),)),
    Bridge("assets_split", "total_assets", ((1, "current_assets"), (1, "noncurrent_assets")), required=False),
    Bridge("liabilities_split", "total_liabilities", ((1, "current_liabilities"), (1, "noncurrent_liabilities")), required=False),
    Bridge("equity_split", "total_equity", ((1, "parent_equity"), (1, "minority_equity")), required=False),
    Bridge("gross_profit", "gross_profit", ((1, "revenue"), (-1, "cost_of_sales")), required=False),
    Bridge("net_profit", "net_profit", ((1, "profit_before_tax"), (-1, "income_tax")), required=False),
    Bridge("profit_split", "net_profit", ((1, "parent_profit"), (1, "minority_profit")), required=False),
    Bridge("cash_change", "cash_change", ((1, "cfo"), (1, "cfi"), (1, "cff"), (1, "fx")), required=False, zero_if_missing=("fx",)),
    Bridge("cash_end", "cash_end", ((1, "cash_begin"), (1, "cash_change"), (1, "fx")), required=False, zero_if_missing=("fx",)),
    Bridge("cash_match", "cash_balance", ((1, "cash_end"),), required=False, share=0.01, least=5.0),
)


def checked(rows: DataFrame, keys: list[str], rules=BRIDGES) -> DataFrame:
    """keys, rule_id, status: every rule on every row in one pass. A failed balance is a warning where the stated total
    of liabilities and equity agrees with assets. Items that the rows lack are null."""
    names = {n for r in rules for n in (r.total, *(p for _, p in r.parts))}
    rows = rows.select(*keys, *[F.col(n) if n in rows.columns else F.lit(None).cast("decimal(38,6)").alias(n) for n in sorted(names)])
    status = {r.rule_id: r.status() for r in rules}
    if "balance" in status and "balance_total" in status:
        status["balance"] = F.when((status["balance"] == "fail") & (status["balance_total"] == "pass"), "warning").otherwise(status["balance"])
    found = F.array(*[F.struct(F.lit(k).alias("rule_id"), s.alias("status")) for k, s in status.items()])
    return rows.select(*keys, F.explode(found).alias("c")).select(*keys, "c.rule_id", "c.status")


def first_formula(*formulas: Column) -> Column:
    """The first formula whose inputs are all there."""
    return F.coalesce(*formulas)


def alerts(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys, rule_id: one row for each rule that a row sets off."""
    fired = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return rows.select(*keys, F.explode(fired).alias("rule_id"))


def enforce(decision: str, hard: bool = False, force: bool = False, requester: str | None = None, reason: str | None = None) -> str:
    """A gate's last word: blocks stand, reviews may be forced by a named person for a reason, hard rules never."""
    if force and decision == "allow":
        raise ValueError("an allowed target needs no force")
    if decision == "block" or decision == "review" and not force:
        raise PermissionError(f"gate says {decision}")
    if decision == "review" and (hard or not requester or not reason):
        raise PermissionError("a review is forced by a requester with a reason, and never against a hard rule")
    return "forced" if force else "allowed"
