"""Text functions: categories of charges, model names and families, project names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import bracket, round_significant, significant_digits

#: The categories, and what descriptions contain that belong to them, in order of precedence.
CATEGORIES = ("subscription", "overage", "refund", "one_time", "unknown")
NEEDLES = (
    ("refund", ("refund", "credit memo", "chargeback")),
    ("overage", ("overage", "usage", "metered", "api usage")),
    ("subscription", (
        "subscription", "monthly", "recurring", "pro plan", "max plan", "team plan", "claude pro", "claude max", "claude team",
    )),
    ("one_time", ("setup", "onboarding", "one-time", "one time")),
)
FAMILIES = ("opus", "sonnet", "haiku")
TOKEN_NAMES = {
    "input_tokens": "Input", "output_tokens": "Output", "cache_read_tokens": "Cache read",
    "cache_write_5m_tokens": "Cache write 5m", "cache_write_1h_tokens": "Cache write 1h",
}


def categorize(description: Column, amount: Column) -> Column:
    """Category of a charge: refunds are negative or say so; then overage, subscription, one_time, unknown."""
    text = F.lower(F.coalesce(description, F.lit("")))
    found = F.when(amount < 0, "refund")
    for category, needles in NEEDLES:
        contains = F.lit(False)
        for needle in needles:
            contains = contains | text.contains(needle)
        found = found.when(contains, category)
    return found.otherwise("unknown")


def decode_category(text: Column) -> Column:
    """Unknown categories mean ``unknown``."""
    return F.when(text.isin(*CATEGORIES), text).otherwise("unknown")


def model_display_name(model: Column) -> Column:
    """``claude-opus-4-7`` becomes ``Claude Opus 4.7``; other names stay."""
    pattern = r"^claude-(opus|sonnet|haiku)-(\d+)-(\d+)$"
    part = lambda k: F.regexp_extract(model, pattern, k)
    return F.when(model.rlike(pattern), F.concat(F.lit("Claude "), F.initcap(part(1)), F.lit(" "), part(2), F.lit("."), part(3))).otherwise(model)


def model_family(model: Column) -> Column:
    found = F
    for family in FAMILIES:
        found = found.when(model.contains(family), family)
    return found.otherwise("other")


def project_short_name(project: Column) -> Column:
    """Last part of a path; names of more than 40 characters keep 37 and an ellipsis."""
    parts = F.filter(F.split(project, "/"), lambda p: p != "")
    name = F.when(F.size(parts) > 0, F.try_element_at(parts, F.lit(-1))).otherwise(project)
    return F.when(F.length(name) > 40, F.concat(F.substring(name, 1, 37), F.lit("…"))).otherwise(name)


def token_type_name(column: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TOKEN_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, column), column)


def _fixed(value: Column, digits: int) -> Column:
    """Decimals without separators; a single decimal of zero goes."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", value.cast("double")), r"^(-?\d+)\.0$", "$1")


def _plain(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def _compact(value: Column, rest: Column) -> Column:
    found = F
    for limit, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        found = found.when(F.abs(value) >= limit, F.concat(_fixed(value / limit, 1), F.lit(unit)))
    return found.otherwise(rest)


def compact_number(value: Column) -> Column:
    """1234 becomes 1.2K, 2000 becomes 2K; also M and B. Smaller numbers stay as they are."""
    return _compact(value, _plain(value))


def compact_dollars(value: Column) -> Column:
    """As :func:`compact_number`; whole dollars below a thousand, cents below one."""
    rest = F.when(F.abs(value) >= 1, _fixed(value, 0)).otherwise(_fixed(value, 2))
    return F.concat(F.lit("$"), _compact(value, rest))


def exact_dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def rounded_dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.round(value), 0))


#: From which size on a unit is used, the size of the unit, its name.
ENERGY_UNITS = ((1e6, 1e6, "MWh"), (1e3, 1e3, "kWh"), (1.0, 1.0, "Wh"), (1e-3, 1e-3, "mWh"), (0.0, 1e-6, "µWh"))
CARBON_UNITS = ((1e6, 1e6, "t CO₂e"), (1e3, 1e3, "kg CO₂e"), (1.0, 1.0, "g CO₂e"), (1e-3, 1e-3, "mg CO₂e"), (0.0, 1.0, "g CO₂e"))
WATER_UNITS = ((1e3, 1e3, "kL"), (1.0, 1.0, "L"), (0.0, 1e-3, "mL"))


def scaled(value: Column, units: tuple[tuple[float, float, str], ...], uncertainty_pct: Column | None = None) -> Column:
    """The value in the largest unit that it reaches: two decimals, or as many digits as its band allows."""
    pct = F.lit(0) if uncertainty_pct is None else uncertainty_pct
    found = F
    for least, size, name in units:
        shown = value / size
        precise = F.when(pct > 0, _plain(round_significant(shown, significant_digits(pct)))).otherwise(_fixed(shown, 2))
        found = found.when(F.abs(value) >= least, F.concat(precise, F.lit(" " + name)))
    return found


def bracketed(value: Column, units: tuple[tuple[float, float, str], ...], uncertainty_pct: Column) -> Column:
    """``~value (low – high) ± pct%``; the value alone without a band."""
    ends = bracket(value, uncertainty_pct)
    low, high = (scaled(ends[k], units, uncertainty_pct) for k in ("low", "high"))
    whole = F.concat(F.lit("~"), scaled(value, units, uncertainty_pct), F.lit(" ("), low, F.lit(" – "), high, F.lit(") ± "), uncertainty_pct.cast("string"), F.lit("%"))
    return F.when(uncertainty_pct > 0, whole).otherwise(scaled(value, units))
