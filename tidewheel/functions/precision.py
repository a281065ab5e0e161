"""Exact decimals as scaled integers, and the parsers of tickers and amounts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 18
#: Quote currencies that a pair written without a delimiter may end in; the first that fits counts.
QUOTES = (
    "EURI", "EUR", "FDUSD", "BFUSD", "RWUSD", "USD1", "BNFCR", "USD", "GBP", "USDP", "USDS", "PLN", "RON", "CZK", "TRY", "JPY",
    "BRL", "RUB", "AUD", "NGN", "MXN", "COP", "ARS", "BKRW", "IDRT", "UAH", "BIDR", "BVND", "ZAR",
    "USDT", "USDC", "UST", "BTC", "WETH", "ETH", "BNB", "SOL", "XRP", "PAX", "DAI", "VAI", "DOGE", "DOT", "TRX",
)


def raw(text: Column, precision: int) -> Column:
    """value * 10^precision as a long; fails if a digit would be lost. Trailing zeros are no digits."""
    if not -MOST <= precision <= MOST:
        raise ValueError(f"precision {precision} is not within {MOST}")
    t = F.btrim(text)
    form = r"^([+-]?)(\d+)(?:\.(\d*))?$"
    sign, whole, part = (F.regexp_extract(t, form, i) for i in (1, 2, 3))
    part = F.regexp_replace(part, "0+$", "")
    if precision >= 0:
        fits, digits = F.length(part) <= precision, F.concat(whole, F.rpad(part, precision, "0"))
    else:
        fits = (part == "") & (F.regexp_like(whole, F.lit(f"0{{{-precision}}}$")) | F.regexp_like(whole, F.lit("^0+$")))
        digits = F.regexp_replace(whole, f"0{{{-precision}}}$", "")
    good = F.regexp_like(t, F.lit(form)) & fits
    value = F.concat(sign, F.when(digits == "", "0").otherwise(digits)).cast("long")
    lost = F.raise_error(F.concat(F.lit(f"no number, or digits lost at precision {precision}: "), text)).cast("long")
    return F.when(text.isNull(), F.lit(None).cast("long")).when(good, value).otherwise(lost)


def decoded(value: Column, precision: int) -> Column:
    return value / float(10**precision) if precision >= 0 else value * float(10**-precision)


def realigned(value: Column, was: int, now: int) -> Column:
    """A raw value at another precision; fails if digits would be lost."""
    if now >= was:
        return value * 10 ** (now - was)
    step = 10 ** (was - now)
    return F.when(value % step == 0, F.floor(value / step).cast("long")).otherwise(F.raise_error(F.lit("digits lost in realignment")).cast("long"))


def ns_from_seconds(text: Column) -> Column:
    """Nanoseconds since the epoch from decimal seconds."""
    return raw(text, 9)


def pair(text: Column) -> tuple[Column, Column]:
    """Base and quote, upper case: by a delimiter (``-``, ``,``, ``_``, ``/``), else by a known quote at the end.

    Both are null where the text is no pair.
    """
    t = F.upper(F.regexp_replace(text, r"\s", ""))
    by_sign = r"^([A-Z0-9]{1,16})[-,_/]([A-Z0-9]{1,16})$"
    quote = F.coalesce(*[F.when(F.endswith(t, F.lit(q)), F.lit(q)) for q in QUOTES])
    base = F.substring(t, 1, F.length(t) - F.length(quote))
    whole = F.regexp_like(base, F.lit("^[A-Z0-9]{1,16}$"))
    signed = F.regexp_like(t, F.lit(by_sign))
    first = F.when(signed, F.regexp_extract(t, by_sign, 1)).when(whole, base)
    return first, F.when(signed, F.regexp_extract(t, by_sign, 2)).when(whole, quote)


#: What a symbol's instrument adds to its pair.
INSTRUMENTS = {"Spot": "", "Perp": ".P", "Margin": ".M", "PerpInverse": ".PERP_INVERSE", "Options": ".OPTIONS"}


def symbol(text: Column) -> tuple[Column, Column, Column]:
    """Base, quote and instrument of a symbol such as ``BTC-USDT.P``; all null if it is none."""
    suffix = F.regexp_extract(F.upper(F.btrim(text)), r"(\.[A-Z_]+)?$", 0)
    kind = F.coalesce(*[F.when(suffix == mark, F.lit(name)) for name, mark in INSTRUMENTS.items()])
    base, quote = pair(F.regexp_replace(F.btrim(text), r"\.[A-Za-z_]+$", ""))
    good = kind.isNotNull() & base.isNotNull()
    return F.when(good, base), F.when(good, quote), F.when(good, kind)


def ticker(base: Column, quote: Column, instrument: Column | None = None, venue: str | None = None) -> Column:
    """A pair as written: ``BASE-QUOTE`` and the instrument's mark, or in a venue's way."""
    if venue in ("binance", "bybit"):
        return F.concat(base, quote)
    if venue == "mexc":
        return F.concat(base, F.lit("_"), quote)
    mark = F.lit("") if instrument is None else F.coalesce(*[F.when(instrument == name, F.lit(m)) for name, m in INSTRUMENTS.items()])
    return F.concat(base, F.lit("-"), quote, mark)


def usd(text: Column) -> Column:
    """An amount with an optional ``$`` and thousands marks, as a double; null if it is none."""
    bare = F.regexp_replace(F.btrim(text), r"[$,_\s]", "")
    return F.when(F.regexp_like(bare, F.lit(r"^[+-]?\d+(\.\d*)?([eE][+-]?\d+)?$")), bare.cast("double"))


def parse_pair(text: str) -> tuple[str, str]:
    """The driver's form of ``pair``; raises ValueError."""
    t = re.sub(r"\s", "", text).upper()
    if m := re.fullmatch(r"([A-Z0-9]{1,16})[-,_/]([A-Z0-9]{1,16})", t):
        return m[1], m[2]
    quote = next((q for q in QUOTES if t.endswith(q)), None)
    if quote is None or not re.fullmatch("[A-Z0-9]{1,16}", t[: -len(quote)]):
        raise ValueError(f"not a pair: {text!r}")
    return t[: -len(quote)], quote
