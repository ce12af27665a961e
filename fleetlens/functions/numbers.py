"""Numbers for people and counters wider than 64 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values. -------------------------------------------------------------
UNITS = ("", "k", "M", "G", "T", "P", "E", "Z", "Y")
INTEGER_BITS = {"tinyint": 8, "smallint": 16, "mediumint": 24, "int": 32, "bigint": 64}
PORTS = {"memcached": 11211, "http": 80, "mysql": 3306}
# --------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _plain(x: Column, places: int) -> Column:
    """Fixed-point text without insignificant zeros."""
    fixed = F.format_string(f"%.{places}f", x)
    return F.regexp_replace(fixed, r"(\.\d*?)0+\z", "$1") if places else fixed


def micro_t(seconds, p_ms: int = 0, p_s: int = 0) -> Column:
    """A time as ``us``, ``ms`` or ``s``; digits past the sixth are cut off."""
    t = F.greatest(_c(seconds).cast("double"), F.lit(0.0))
    micros = F.floor(t * 1000000 + 1e-6).cast("long")
    cut = micros / F.lit(1000000.0)

    def trimmed(x: Column, places: int) -> Column:
        return F.regexp_replace(_plain(x, places), r"\.\z", "")

    return (
        F.when((micros > 0) & (micros <= 999), F.concat(micros.cast("string"), F.lit("us")))
        .when((micros >= 1000) & (micros <= 999999), F.concat(trimmed(micros / 1000.0, p_ms), F.lit("ms")))
        .when(cut >= 1, F.concat(trimmed(cut, p_s), F.lit("s")))
        .otherwise(F.lit("0"))
    )


def shorten_number(num, places: int = 2, base: int = 1024) -> Column:
    """``12.34k`` style; whole numbers under the base stay whole."""
    num = _c(num).cast("double")
    steps = F.lit(0)
    for i in range(1, len(UNITS)):
        steps = F.when(num >= F.lit(float(base) ** i), F.lit(i)).otherwise(steps)
    scaled = num / F.pow(F.lit(float(base)), steps)
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), steps + 1)
    whole = (steps == 0) & (num == F.floor(num))
    return F.when(whole, F.format_string("%d", num.cast("long"))).otherwise(
        F.concat(F.format_string(f"%.{places}f", scaled), unit)
    )


def percentage_of(part, whole, places: int = 0) -> Column:
    """Percent as text; without places it is cut, not rounded. A zero whole counts as 1."""
    of = F.when(F.coalesce(_c(whole), F.lit(0)) == 0, F.lit(1)).otherwise(_c(whole))
    pct = _c(part) * 100 / of
    if places:
        return F.format_string(f"%.{places}f", pct.cast("double"))
    return pct.cast("long").cast("string")


def nearest(step: float, x) -> Column:
    """Half-up rounding to a multiple of ``step``."""
    x = _c(x)
    return F.signum(x) * F.floor(F.abs(x) / step + 0.5) * step


def nearest_cent(x) -> Column:
    return F.round(_c(x), 2)


def big(x) -> Column:
    return _c(x).cast("decimal(38,0)")


def hi_lo(hi, lo=None) -> Column:
    """One wide counter from two 32-bit halves, or from one hexadecimal text."""
    if lo is None:
        return F.conv(_c(hi), 16, 10).cast("decimal(38,0)")
    two = (big(hi) * F.lit(4294967296).cast("decimal(11,0)") + big(lo)).cast("decimal(38,0)")
    one = F.conv(_c(hi), 16, 10).cast("decimal(38,0)")
    return F.when(_c(lo).isNull(), one).otherwise(two)


def integer_limit(type_name) -> Column:
    """Largest value of a declared integer type, as DECIMAL(20,0)."""
    t = F.regexp_replace(F.lower(_c(type_name)), " zerofill", "")
    base = F.regexp_extract(t, r"\A([a-z]+)", 1)
    unsigned = t.contains("unsigned")
    out = F.lit(None).cast("decimal(20,0)")
    for name, bits in INTEGER_BITS.items():
        names = [name, "integer"] if name == "int" else [name]
        out = F.when(
            base.isin(*names),
            F.when(unsigned, F.lit(str(2**bits - 1))).otherwise(F.lit(str(2 ** (bits - 1) - 1))).cast("decimal(20,0)"),
        ).otherwise(out)
    return out


def port_number(port) -> Column:
    """Well-known port names as numbers; anything else is unchanged."""
    port = _c(port)
    out = port
    for name, number in PORTS.items():
        out = F.when(port == name, F.lit(str(number))).otherwise(out)
    return out


def ip_to_long(ip) -> Column:
    """IPv4 text as BIGINT, NULL for anything else."""
    ip = _c(ip)
    octet = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    value = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(ip.rlike(r"\A(?:\d{1,3}\.){3}\d{1,3}\z"), value)
