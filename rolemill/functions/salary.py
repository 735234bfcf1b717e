"""Free-text salary to (min, max, currency, period)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.text import EDGE, WS, first_match, let, round_half_up, trim_ws

# Currency signs in test order, then the codes that count as words.
CURRENCY_SIGNS = [("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("¥", "JPY")]
CURRENCY_CODES = "USD|GBP|EUR|JPY|AUD|CAD|SGD|INR"

# Pay period spellings in test order.
PERIODS = [
    (rf"per{WS}*hour|/{WS}*hr{EDGE}|/{WS}*hour{EDGE}|hourly", "hourly"),
    (rf"per{WS}*month|/{WS}*mo{EDGE}|monthly", "monthly"),
    (rf"per{WS}*year|/{WS}*yr{EDGE}|yearly|annually", "yearly"),
]

# One amount, and two amounts joined by a range sign.
AMOUNT = rf"\$?{WS}*[\d.,]+[kKmM]?"
RANGE = rf"({AMOUNT}){WS}*(?:-|–|—|to){WS}*({AMOUNT})"

SALARY_TYPE = (
    "struct<salary_min:bigint,salary_max:bigint,salary_currency:string,salary_period:string>"
)


def parse_amount(token: Column) -> Column:
    """``"$1.5k"`` to 1500; anything but one plain number with k/m suffix is null."""
    def parse(clean: Column) -> Column:
        number = rf"\A(\d+(?:\.\d+)?){WS}*([kKmM])?\z"
        unit = F.lower(F.regexp_extract(clean, number, 2))
        factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
        digits = first_match(clean, number, 1).cast("double")
        return round_half_up(digits * factor).cast("bigint")

    return let(trim_ws(F.regexp_replace(token, "[,$£€¥]", "")), parse)


def _currency(text: Column) -> Column:
    rule = F.when(text.isNull(), F.lit(None).cast("string"))
    for sign, code in CURRENCY_SIGNS:
        rule = rule.when(F.contains(text, F.lit(sign)), code)
    return rule.otherwise(F.upper(first_match(text, f"(?i){EDGE}({CURRENCY_CODES}){EDGE}", 1)))


def _period(text: Column) -> Column:
    rule = F.when(text.isNull(), F.lit(None).cast("string"))
    for pattern, period in PERIODS:
        rule = rule.when(text.rlike(f"(?i){EDGE}(?:{pattern}){EDGE}"), period)
    # No keyword: four or more digits in the whole text mean a yearly figure.
    return rule.when(F.length(F.regexp_replace(text, "[^0-9]", "")) >= 4, "yearly")


def parse_salary(text: Column) -> Column:
    """Struct of min, max, currency and period; all null when no amount is found."""
    def build(t: Column) -> Column:
        low = parse_amount(first_match(t, RANGE, 1))
        high = parse_amount(first_match(t, RANGE, 2))
        single = parse_amount(first_match(t, AMOUNT))

        def pick(a: Column) -> Column:
            ranged = a["low"].isNotNull() & a["high"].isNotNull()
            found = ranged | a["single"].isNotNull()
            return F.struct(
                F.when(ranged, a["low"]).otherwise(a["single"]).alias("salary_min"),
                F.when(ranged, a["high"]).alias("salary_max"),
                F.when(found, _currency(t)).alias("salary_currency"),
                F.when(found, _period(t)).alias("salary_period"),
            )

        return let(F.struct(low.alias("low"), high.alias("high"), single.alias("single")), pick)

    return let(trim_ws(text), build).cast(SALARY_TYPE)
