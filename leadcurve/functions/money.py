"""Revenue, order bumps and net income."""

from leadcurve.constants import BUMP_PRICE, LIST_PRICE, NET_BUMP, NET_SALE
from leadcurve.functions.numbers import half_up

MONEY = "decimal(18,2)"


def sum_money(amount: str) -> str:
    """Exact sum of amounts with two decimals.

    Summed as whole cents, so that the aggregation buffer is a long, and
    turned back into a decimal once per group.
    """
    return f"cast(cast(sum(cast(({amount}) * 100 as bigint)) as decimal(20,0)) * 0.01 as {MONEY})"


def money_or_nothing(amount: str) -> str:
    return f"cast(coalesce({amount}, 0) as {MONEY})"


def revenue_or_list_price(value: str, sales: str) -> str:
    """Reported revenue, or sales at list price when none was reported."""
    # 12 digits of sales keep the product within the 18 that fit a long
    listed = f"cast({sales} as decimal(12,0)) * {LIST_PRICE}"
    return f"(case when {value} > 0 then cast({value} as {MONEY}) else cast({listed} as {MONEY}) end)"


def net_income(revenue: str, sales: str) -> str:
    """Net of sales and of the order bumps that the revenue implies.

    Both prices are fixed, so revenue above sales at list price tells how
    many bumps were sold. Zero sales give zero.
    """
    n, gross = f"coalesce({sales}, 0)", f"coalesce({revenue}, 0)"
    extra = f"cast(cast({gross} - {n} * {LIST_PRICE} as {MONEY}) as double) / {BUMP_PRICE}D"
    bumps = f"greatest(cast({half_up(extra)} as bigint), 0L)"
    net = f"{n} * {NET_SALE} + {bumps} * {NET_BUMP}"
    return f"cast(case when {n} = 0 then 0 else {net} end as {MONEY})"
