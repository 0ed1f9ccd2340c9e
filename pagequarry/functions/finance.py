"""Ratios, growth and units as native expressions. Errors are null values with a message beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, words and factors that queries and tables are matched with.
VARIABLES = [
    "revenue", "gross_profit", "operating_income", "net_income", "total_assets", "current_assets", "inventory", "total_liabilities",
    "current_liabilities", "shareholders_equity", "interest_expense", "ebitda", "market_cap", "enterprise_value", "value_current",
    "value_prior", "start_value", "end_value", "years",
]
UNITS = {
    "b": 1e9, "bn": 1e9, "billion": 1e9, "m": 1e6, "mm": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3,
    "w": 1e4, "wan": 1e4, "y": 1e8, "yi": 1e8, "%": 0.01,
}
CJK_UNITS = {"万": 1e4, "亿": 1e8}
METRIC_WORDS = {
    "gross_profit_margin": ["gross profit margin", "gpm"],
    "operating_profit_margin": ["operating profit margin", "opm", "operating margin"],
    "net_profit_margin": ["net profit margin", "npm", "net margin"],
    "roe": ["return on equity", "roe"],
    "roa": ["return on assets", "roa"],
    "roic": ["return on invested capital", "roic"],
    "current_ratio": ["current ratio"],
    "quick_ratio": ["quick ratio", "acid test"],
    "debt_to_equity": ["debt to equity", "d/e", "debt-to-equity"],
    "debt_to_assets": ["debt to assets", "debt-to-assets"],
    "interest_coverage": ["interest coverage", "times interest earned"],
    "yoy_revenue_growth": ["yoy", "year over year", "year-on-year", "yoy revenue"],
    "cagr": ["cagr", "compound annual growth"],
    "pe_ratio": ["p/e", "pe ratio", "price to earnings"],
    "ev_ebitda": ["ev/ebitda", "enterprise value ebitda"],
}
#: How many fields a metric of the query calculator asks for, and its unit.
REQUIRED_FIELDS = {
    "gross_profit_margin": 3, "operating_profit_margin": 2, "net_profit_margin": 2, "roe": 3, "roa": 2, "roic": 2, "current_ratio": 2,
    "quick_ratio": 3, "debt_to_equity": 4, "debt_to_assets": 2, "interest_coverage": 2, "yoy_revenue_growth": 2, "cagr": 3, "pe_ratio": 4, "ev_ebitda": 2,
}
PERCENT_METRICS = ["gross_profit_margin", "operating_profit_margin", "net_profit_margin", "yoy_revenue_growth", "cagr"]
TIMES_METRICS = ["current_ratio", "quick_ratio", "debt_to_equity", "debt_to_assets", "interest_coverage", "roic", "pe_ratio"]

#: metric -> (numerator, denominator, factor); names are variables, a pair is a difference.
_RATIOS = {
    "gross_profit_margin": ("gross_profit", "revenue", 100),
    "operating_profit_margin": ("operating_income", "revenue", 100),
    "net_profit_margin": ("net_income", "revenue", 100),
    "roe": ("net_income", "shareholders_equity", 100),
    "roa": ("net_income", "total_assets", 100),
    "current_ratio": ("current_assets", "current_liabilities", 1),
    "quick_ratio": (("current_assets", "inventory"), "current_liabilities", 1),
    "debt_to_equity": ("total_liabilities", "shareholders_equity", 1),
    "debt_to_assets": ("total_liabilities", "total_assets", 1),
    "interest_coverage": ("operating_income", "interest_expense", 1),
    "yoy_growth": (("value_current", "value_prior"), "value_prior", 100),
    "pe_ratio": ("market_cap", "net_income", 1),
    "ev_ebitda": ("enterprise_value", "ebitda", 1),
}
RATIO_METRICS = [*_RATIOS, "cagr"]


def cagr_percent(start: Column, end: Column, years: Column) -> Column:
    """Null unless start and years are positive and end isn't negative."""
    ok = (start > 0) & (years > 0) & (end >= 0)
    return F.round(F.when(ok, (F.pow(end / F.when(start > 0, start), 1.0 / F.when(years > 0, years)) - 1) * 100), 4)


def yoy_percent(current: Column, prior: Column) -> Column:
    return F.round(F.try_divide(current - prior, prior) * 100, 4)


def ratio(metric: str, value) -> Column:
    """A named ratio; ``value(name)`` gives the column of a variable. Null where it can't be computed."""
    if metric == "cagr":
        return cagr_percent(value("start_value"), value("end_value"), value("years"))
    top, below, factor = _RATIOS[metric]
    numerator = value(top[0]) - value(top[1]) if isinstance(top, tuple) else value(top)
    return F.round(F.try_divide(numerator.cast("double"), value(below).cast("double")) * factor, 4)


def ratio_unit(metric: Column) -> Column:
    return F.when(metric.contains("margin") | metric.contains("growth") | metric.contains("coverage"), "%").otherwise("")


def calculate(metric: Column, values: Column) -> tuple[Column, Column, Column]:
    """(result, unit, error) of a metric's name and a map of its variables; formulas are expressions, nothing is evaluated."""
    name = F.lower(metric)
    unknown = F.size(F.array_except(F.map_keys(values), F.array(*map(F.lit, VARIABLES)))) > 0
    result = F.lit(None).cast("double")
    for known in RATIO_METRICS:
        result = F.when(name == known, ratio(known, lambda v: F.element_at(values, v))).otherwise(result)
    named = name.isin(RATIO_METRICS)
    result = F.when(named & ~unknown, result)
    error = F.when(~named, F.concat(F.lit("Unknown metric: "), metric)).when(unknown, F.lit("Unknown variables")).when(result.isNull(), F.lit("not computable"))
    return result, F.when(result.isNotNull(), ratio_unit(name)), error


def unit_factor(unit: Column, cjk_units: bool = False) -> Column:
    known = UNITS | (CJK_UNITS if cjk_units else {})
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(unit)), F.lit(1.0))


def normalize_units(text: Column, target: str = "absolute", cjk_units: bool = False) -> Column:
    """'1,234.5M' -> 1.2345e9; null where it isn't a plain number with a unit."""
    clean = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "[, ]", "")
    pattern = r"^([\d.]+)([a-zA-Z%一-龥]*)$"
    number = F.regexp_extract(clean, pattern, 1).try_cast("double")
    value = number * unit_factor(F.regexp_extract(clean, pattern, 2), cjk_units)
    if target != "absolute":
        value = value / unit_factor(F.lit(target), cjk_units)
    return F.round(value, 4)


def identify_metric(query: Column) -> Column:
    """The first metric, in the declared order, one of whose words is in the query; null if none is."""
    q = F.lower(query)
    found = []
    for metric, words in METRIC_WORDS.items():
        hit = q.contains(words[0])
        for w in words[1:]:
            hit = hit | q.contains(w)
        found.append(F.when(hit, metric))
    return F.coalesce(*found)


def compute_metric(metric: Column, value) -> Column:
    """The query calculator's metrics as plain fractions; ``value(name)`` gives a field's column, null where it is missing."""
    divide = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    equity = F.coalesce(value("shareholders_equity"), value("equity"), F.lit(1.0))
    debt = value("total_liabilities")  # tables never give total_debt by itself
    formulas = {
        "gross_profit_margin": divide(value("gross_profit"), value("revenue")),
        "operating_profit_margin": divide(value("operating_income"), value("revenue")),
        "net_profit_margin": divide(value("net_income"), value("revenue")),
        "roe": divide(value("net_income"), equity),
        "roa": divide(value("net_income"), value("total_assets")),
        "roic": divide(value("nopat"), value("invested_capital")),
        "current_ratio": divide(value("current_assets"), value("current_liabilities")),
        "quick_ratio": divide(value("current_assets") - F.coalesce(value("inventory"), F.lit(0.0)), value("current_liabilities")),
        "debt_to_equity": divide(debt, equity),
        "debt_to_assets": divide(debt, value("total_assets")),
        "interest_coverage": divide(value("ebit"), value("interest_expense")),
        "pe_ratio": divide(F.lit(0.0), value("net_income")),  # no alias gives a market cap
    }
    result = F.lit(None).cast("double")
    for name, formula in formulas.items():
        result = F.when(metric == name, formula).otherwise(result)
    return F.round(result, 4)


def metric_unit(metric: Column) -> Column:
    return F.when(metric.isin(PERCENT_METRICS), "%").when(metric.isin(TIMES_METRICS), "x").otherwise("")
