"""The callable surface: named tools with checked arguments, offered only where the shop's sources support them."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tallyspark.context import BadArgument, Caveat, DateRange, Filters, Shop, resolve_name, resolve_period
from tallyspark.operators import demand, inventory, sales, scopes, staffing
from tallyspark.operators.definitions import definition


@dataclass(frozen=True)
class Tool:
    name: str
    call: Callable[..., DataFrame]
    arguments: dict[str, type]
    requires: tuple[str, ...] = field(default=())
    #: Metrics whose definitions its description quotes.
    of: tuple[str, ...] = ()

    def description(self) -> str:
        return " ".join(definition(k).sentence() for k in self.of)


def _period(today: dt.date, a: dict) -> DateRange:
    return resolve_period(today, a.get("start"), a.get("end"))


def _filters(shop: Shop, a: dict) -> Filters:
    """Filters by id, or by the names of locations and categories: exact, or part of only one."""
    places, kinds = list(a.get("location_ids", ())), list(a.get("category_ids", ()))
    if a.get("locations"):  # a shop's locations and categories are few
        known = {r.name: r.location_id for r in shop.locations.select("location_id", "name").collect()}
        places += [resolve_name(known, n) for n in a["locations"]]
    if a.get("categories"):
        known = {r.category_id: r.category_id for r in shop.variants.select("category_id").filter("category_id is not null").distinct().collect()}
        kinds += [resolve_name(known, n) for n in a["categories"]]
    return Filters(location_ids=tuple(places), channels=tuple(a.get("channels", ())), category_ids=tuple(kinds))


def _catalog(shop: Shop, today: dt.date, a: dict) -> DataFrame:
    """A page of the catalog."""
    return inventory.catalog_page(shop, today, a.get("query"), a.get("sort", "name"), a.get("descending", False), a.get("limit", 20), a.get("offset", 0), _filters(shop, a), totals=True)


def _search(shop: Shop, today: dt.date, a: dict) -> DataFrame:
    """Passages of products and documents; of a shop that has none, or for a page of variants by name, the catalog."""
    if shop.knowledge is None or not a.get("query") or set(a) - {"query", "kind", "limit"}:
        if "kind" in a:
            raise BadArgument("search_catalog: kind goes with a query, and with a shop whose passages are indexed")
        return _catalog(shop, today, a)
    return shop.knowledge.search(a["query"], a.get("limit", 8), a.get("kind"))


_NAMED = {"location_ids": list, "category_ids": list, "locations": list, "categories": list}
_SALES = {"start": dt.date, "end": dt.date, "channels": list} | _NAMED
_RANKED = _SALES | {"limit": int}
_STOCK = _NAMED | {"limit": int}
TOOLS = {
    t.name: t
    for t in (
        Tool("sales_summary", lambda s, d, a: sales.sales_summary(s, _period(d, a), _filters(s, a)), _SALES, of=("net_sales",)),
        Tool("sales_over_time", lambda s, d, a: sales.sales_series(s, _period(d, a), a.get("grain", "week"), _filters(s, a)), _SALES | {"grain": str}),
        Tool("top_products", lambda s, d, a: sales.breakdown(s, _period(d, a), "product", _filters(s, a), a.get("limit", 10)), _RANKED),
        Tool("category_breakdown", lambda s, d, a: sales.breakdown(s, _period(d, a), "category", _filters(s, a), a.get("limit", 25)), _RANKED),
        Tool("location_channel_breakdown", lambda s, d, a: sales.breakdown(s, _period(d, a), a.get("by", "channel"), _filters(s, a), a.get("limit", 25)), _RANKED | {"by": str}),
        Tool("low_stock", lambda s, d, a: inventory.low_stock(s, d, _filters(s, a), a.get("limit", 50)), _STOCK, of=("low_stock", "days_of_cover")),
        Tool("dead_stock", lambda s, d, a: inventory.dead_stock(s, d, _filters(s, a), a.get("limit", 50)), _STOCK, of=("dead_stock",)),
        Tool("sell_through", lambda s, d, a: inventory.sell_through(s, _period(d, a), _filters(s, a), a.get("limit", 20)), _RANKED, of=("sell_through",)),
        Tool("inventory_value", lambda s, d, a: inventory.inventory_value(s, _filters(s, a)), _STOCK, of=("inventory_value",)),
        Tool("margin_report", lambda s, d, a: sales.margin_report(s, _period(d, a), _filters(s, a)), _SALES, ("has_costs",), ("gross_margin", "cost_coverage")),
        Tool("customer_stats", lambda s, d, a: sales.customer_stats(s, _period(d, a), _filters(s, a)), _SALES, ("has_customers",), ("repeat_rate", "new_vs_returning")),
        Tool("reorder_suggestions", lambda s, d, a: demand.suggestions(s, d, a.get("limit", 50)), {"limit": int}),
        Tool("search_catalog", _search, _STOCK | {"query": str, "kind": str, "sort": str, "descending": bool, "offset": int}),
        Tool("catalog_page", _catalog, _STOCK | {"query": str, "sort": str, "descending": bool, "offset": int}),
        Tool("busiest_hours", lambda s, d, a: staffing.busiest_hours(s, d, a.get("weekday"), a.get("limit", 8)), {"weekday": int, "limit": int}),
    )
}
#: Tools whose figures contain refunds, those that read stock, and those that answer in one row.
_WITH_REFUNDS = {"sales_summary", "sales_over_time", "location_channel_breakdown"}
_OF_STOCK = {"low_stock", "dead_stock", "sell_through", "inventory_value", "search_catalog", "catalog_page"}
_OF_ONE_ROW = {"sales_summary", "margin_report", "inventory_value", "customer_stats"}


def available(shop: Shop) -> list[str]:
    return [t.name for t in TOOLS.values() if set(t.requires) <= shop.capabilities]


def call(shop: Shop, today: dt.date, name: str, arguments: dict) -> DataFrame:
    """The tool's frame; an unknown tool, argument or type is refused with what there is, a missing capability with its name."""
    if name not in TOOLS:
        raise BadArgument(f"there is no tool {name!r}; there are {', '.join(TOOLS)}")
    tool = TOOLS[name]
    shop.require(*tool.requires)
    for k, v in arguments.items():
        if k not in tool.arguments:
            raise BadArgument(f"{name} takes no {k!r}; it takes {', '.join(tool.arguments)}")
        if not isinstance(v, tool.arguments[k]):
            raise BadArgument(f"{name}: {k} must be a {tool.arguments[k].__name__}")
    return tool.call(shop, today, arguments)


@dataclass(frozen=True)
class Answer:
    """A tool's frame with what it is of, and what its reader has to know for its numbers to mean what they say."""

    frame: DataFrame = field(repr=False)
    currency: str
    timezone: str
    period: DateRange | None
    caveats: tuple[Caveat, ...]


def _rules(shop: Shop, today: dt.date, name: str) -> dict[str, str]:
    """What a tool's list means."""
    cutoff, days = today - dt.timedelta(days=shop.dead_stock_days), inventory.VELOCITY_DAYS
    return {
        "top_products": {"breakdown_before_refunds": "a refund names an order, not a product, so rows are before refunds"},
        "category_breakdown": {"breakdown_before_refunds": "a refund names an order, not a category, so rows are before refunds"},
        "margin_report": {"margin_before_refunds": "profit is of what was sold, before refunds"},
        "low_stock": {"low_stock_rule": f"sold in the last {days} days, with {shop.low_stock_threshold} or fewer left or less than {inventory.COVER_DAYS} days of cover"},
        "dead_stock": {"dead_stock_rule": f"on the shelf and not sold since {cutoff}"},
    }.get(name, {})


def _of_row(name: str, row) -> list[Caveat]:
    """What a one-row answer says about itself."""
    out = []
    if name == "sales_summary":
        out.append(sales.custom_amount_caveat(row.custom_amounts, row.net_sales))
    if name in ("margin_report", "inventory_value") and row.cost_coverage is not None and row.cost_coverage < 1:
        out.append(Caveat("partial_cost_coverage", f"only {row.cost_coverage:.1%} has a cost; the rest is left out"))
    if name == "inventory_value" and row.unpriced_units > 0:
        out.append(Caveat("unpriced_stock", f"{row.unpriced_units:g} units have no price and add nothing to the value"))
    if name == "customer_stats" and row.identified_share is not None and row.identified_share < 1:
        out.append(Caveat("anonymous_sales", f"{1 - row.identified_share:.1%} of orders name no customer"))
    return [c for c in out if c]


def answer(shop: Shop, today: dt.date, name: str, arguments: dict) -> Answer:
    """As call(), with caveats: of the data's coverage, of filters that can't apply, of rules and of what the figures leave out.

    Only frames of one row are read for it: the first and the last sale, and answers that have one row anyway.
    """
    frame = call(shop, today, name, arguments)
    filters = _filters(shop, arguments)
    period = _period(today, arguments) if "start" in TOOLS[name].arguments else None
    caveats = []
    if period:
        window = sales.data_window(shop).first()
        caveats += sales.coverage_caveats((window.first_day, window.last_day), period)
    if name in _WITH_REFUNDS:
        caveats += scopes.refunds_in(shop, period, filters)[1]
    if name in _OF_STOCK:
        caveats += scopes.stock(shop, filters)[1]
    caveats += [Caveat(code, text) for code, text in _rules(shop, today, name).items()]
    if name in _OF_ONE_ROW:
        caveats += _of_row(name, frame.first())
    return Answer(frame, shop.currency, shop.timezone, period, tuple(caveats))


def numbers(text: str) -> set[float]:
    """Numbers in a text, whatever their thousands separators, signs and currency."""
    return {float(m.replace(",", "")) for m in re.findall(r"-?\d[\d,]*\.?\d*", text) if m.replace(",", "").strip(".-")}


def unsupported_numbers(text: str, facts: set[float], places: int = 2) -> set[float]:
    """Numbers of a text that no fact has, after rounding."""
    known = {round(f, p) for f in facts for p in (0, 1, places)} | facts
    return {n for n in numbers(text) if n not in known}


def check_chart(chart: dict, values: set[float], labels: set[str]) -> None:
    """A chart may only show what tools have returned: 1 to 6 series, 1 to 400 points, known numbers and labels."""
    if chart.get("type") not in ("bar", "line", "pie"):
        raise BadArgument("a chart is a bar, a line or a pie")
    if not 1 <= len(chart.get("y", ())) <= 6 or not 1 <= len(chart.get("data", ())) <= 400:
        raise BadArgument("a chart has 1 to 6 series and 1 to 400 points")
    for row in chart["data"]:
        if str(row.get(chart["x"])) not in labels:
            raise BadArgument(f"no tool returned the label {row.get(chart['x'])!r}")
        for s in chart["y"]:
            if row.get(s) is not None and float(row[s]) not in values:
                raise BadArgument(f"no tool returned {row[s]!r} for {s}")
