"""Exact scalar functions on prices, times and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 1_000_000
NS = 1_000_000_000


def _scaled(value: Column, decimals: Column) -> Column:
    """value / 10**decimals in millionths; past six decimals half rounds up."""
    out = F.when(decimals == 0, value * UNIT)
    for d in range(1, 7):
        out = out.when(decimals == d, value * 10 ** (6 - d))
    return out.otherwise(F.floor((value + 5) / 10).cast("long"))


def packed_decimals(p: Column) -> Column:
    return F.shiftright(p.cast("long"), 29).bitwiseAND(F.lit(7).cast("long"))


def decode_price(p: Column) -> Column:
    """An unsigned packed price: three bits of decimals above 29 of value."""
    return _scaled(p.cast("long").bitwiseAND(F.lit((1 << 29) - 1).cast("long")), packed_decimals(p))


def decode_signed_price(p: Column) -> Column:
    """As above with the value's top bit as its sign."""
    size = _scaled(p.cast("long").bitwiseAND(F.lit((1 << 28) - 1).cast("long")), packed_decimals(p))
    return F.when(p.cast("long").bitwiseAND(F.lit(1 << 28).cast("long")) != 0, -size).otherwise(size)


def decode_quantity(p: Column) -> Column:
    """A packed amount in whole units, half up."""
    return F.floor((decode_price(p) + UNIT // 2) / UNIT).cast("long")


_DECIMAL = r"^[0-9]+(\.[0-9]*)?$"


def _fraction(s: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(s, r"\."), F.lit(2)), F.lit(""))


def parse_fixed_point(s: Column) -> Column:
    """Decimal text in millionths, cut after six digits; null if it isn't plain digits."""
    whole = F.element_at(F.split(s, r"\."), 1)
    return F.when(s.rlike(_DECIMAL), F.try_multiply(whole.try_cast("long"), F.lit(UNIT).cast("long")) + F.rpad(F.substring(_fraction(s), 1, 6), 6, "0").cast("long"))


def round_to_unit(s: Column) -> Column:
    """Decimal text in whole units; the first digit after the point decides."""
    whole = F.element_at(F.split(s, r"\."), 1)
    up = F.when(F.substring(_fraction(s), 1, 1) >= "5", 1).otherwise(0)
    return F.when(s.rlike(_DECIMAL), whole.try_cast("long") + up)


def parse_timestamp(s: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS[.fraction]' (UTC) in ns; null before 1970 or if malformed."""
    good = s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?$")
    parts = F.split(F.substring(s, 12, 8), ":")
    secs = F.datediff(F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    secs = secs + F.get(parts, F.lit(0)).try_cast("long") * 3600 + F.get(parts, F.lit(1)).try_cast("long") * 60 + F.get(parts, F.lit(2)).try_cast("long")
    out = secs * NS + F.rpad(F.coalesce(F.nullif(F.regexp_extract(s, r"\.([0-9]+)$", 1), F.lit("")), F.lit("0")), 9, "0").cast("long")
    return F.when(good & (secs >= 0), out)


def days_from_civil(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def civil_from_days(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int"))


def run_timestamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")


def parse_bool(s: Column) -> Column:
    return F.when(s.isin("True", "true"), True).when(s.isin("False", "false"), False)


def non_empty(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def format_price(p: Column) -> Column:
    return F.concat(F.floor(p / UNIT).cast("string"), F.lit("."), F.lpad((p % UNIT).cast("string"), 6, "0"))


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        now = F.format_string(f"%.1f {unit}", n.cast("double") / F.lit(float(1024**i)))
        out = out.when(n < 1024 ** (i + 1), now) if i < 4 else out.otherwise(now)
    return out


def format_duration(secs: Column) -> Column:
    h, m, s = F.floor(secs / 3600), F.floor(secs % 3600 / 60), secs % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def eta_suffix(done: Column, total: Column, elapsed_secs: Column) -> Column:
    """', ETA <duration>' of what is left at the pace so far; empty while nothing is done and once all is."""
    left = F.floor(elapsed_secs * (total - done) / done)
    return F.when((done > 0) & (done < total), F.concat(F.lit(", ETA "), format_duration(left))).otherwise("")


def record_hash(words: list[Column], prime: int = 1_000_003) -> Column:
    """A polynomial of a record's words modulo 2**64, as a decimal."""
    kind = "decimal(38,0)"
    whole, out = F.lit(str(1 << 64)).cast(kind), F.lit(0).cast(kind)
    for w in words:
        out = ((out * F.lit(prime).cast("decimal(7,0)")).cast(kind) + w.cast(kind)).cast(kind) % whole
    return out.cast("decimal(20,0)")


def slugify(path: Column) -> Column:
    """The last part of a path with other characters as underscores."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1), "[^A-Za-z0-9._-]", "_")


def deviation_bps(price: Column, mid: Column, aggressor_is_ask: Column) -> Column:
    """Twice the distance from the mid, signed by the aggressor if there is one."""
    d = (price - mid) / mid * 2.0 * 10_000.0
    return F.when(aggressor_is_ask.isNull(), F.abs(d)).when(aggressor_is_ask, -d).otherwise(d)


def fixed(x: Column, digits: int = 6) -> Column:
    """Fixed decimals, null as an empty string."""
    return F.coalesce(F.format_string(f"%.{digits}f", x), F.lit(""))


def file_hour(name: Column) -> Column:
    """Hour of '<coin>_<HH>[_rejected].data.gz'."""
    return F.regexp_extract(name, r"_([0-9]{2})(?:_rejected)?\.data", 1).try_cast("int")


def bucket(ts: Column, anchor: Column | int, width: Column | int) -> Column:
    """Start of the interval that holds ts; times before the anchor belong to the first."""
    a = F.lit(anchor).cast("long") if isinstance(anchor, int) else anchor
    w = F.lit(width).cast("long") if isinstance(width, int) else width
    past = F.greatest(ts - a, F.lit(0).cast("long"))
    return a + past - past % w


def midpoint(bid: Column, ask: Column) -> Column:
    """Whole-number mid; one side alone stands for both."""
    both = bid + ask
    return F.coalesce((both - both % 2) / 2, bid, ask).cast("long")


def depth_band(price: Column, reference: Column) -> Column:
    """Whole basis points between a price and a reference, rounded down."""
    d = F.abs(price - reference) * 10_000
    return F.when(reference > 0, ((d - d % reference) / reference).cast("long"))
