"""Column functions that Spark lacks by name."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(ts) -> Column:
    """Microseconds since 1970 of a (zone-less) timestamp under the session's zone, which should be UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def sats(amount) -> Column:
    """Amount in satoshis, half to even like the wire format's validators."""
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.rint(c * 1e8).cast("long")


def contains_text(column: str, text: str) -> Column:
    """Literal, case-insensitive substring test."""
    return F.lower(F.col(column)).contains(text.lower())


def uniform(*parts) -> Column:
    """A reproducible number in [0, 1): the first 12 hexadecimal digits of the SHA-256 of the parts joined by '|'."""
    digest = F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def compact_number(c) -> Column:
    """Integral values without decimals, others with three significant digits and no trailing zeros."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    size = lambda x: F.floor(F.log10(F.abs(x)) + 1e-12).cast("int")
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")
    unit = F.pow(F.lit(10.0), 2 - size(c))
    rounded = F.rint(c * unit) / unit
    mag = size(rounded)  # 999.6 rounds to 1000
    sign = F.when(mag < 0, "-").otherwise("+")
    scientific = F.concat(plain(F.format_string("%.2f", rounded / F.pow(F.lit(10.0), mag))), F.lit("e"), sign, F.lpad(F.abs(mag).cast("string"), 2, "0"))
    text = plain(F.format_string("%.12f", rounded))
    return F.when(c == F.floor(c), F.format_string("%.0f", c)).when((mag < -4) | (mag > 2), scientific).otherwise(text)


@F.pandas_udf(T.StringType())
def canonical_ip(ip: pd.Series) -> pd.Series:
    """The canonical text of an IPv4 or IPv6 address; null if it is none."""

    def one(x):
        try:
            return None if x is None else str(ipaddress.ip_address(x.strip()))
        except ValueError:
            return None

    return ip.map(one)


@F.pandas_udf(T.StructType([T.StructField("bits", T.StringType()), T.StructField("is_global", T.BooleanType())]))
def address_bits(ip: pd.Series) -> pd.DataFrame:
    """The bits of an IPv4 or IPv6 address behind its version (4 or 6), and whether it is a public one (not private, loopback,
    documentation or otherwise reserved); nulls for anything else. IPv4 addresses inside IPv6 stay IPv6."""

    def one(x):
        try:
            a = ipaddress.ip_address(x.strip())
        except (ValueError, AttributeError):
            return None, None
        return f"{a.version}{int(a):0{a.max_prefixlen}b}", a.is_global

    return pd.DataFrame([one(x) for x in ip], columns=["bits", "is_global"])


def ipv4_number(ip) -> Column:
    """The 32-bit number of a dotted IPv4 address of octets up to 255 without leading zeros; null for anything else."""
    c = F.col(ip) if isinstance(ip, str) else ip
    p = F.split(c, r"\.")
    number = sum((F.try_element_at(p, F.lit(k + 1)).cast("long") * (256 ** (3 - k)) for k in range(1, 4)), F.try_element_at(p, F.lit(1)).cast("long") * 256**3)
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(c.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def documentation_ip(ip: str) -> Column:
    """Whether an address lies in one of the three documentation networks."""
    from trailmark.config import DOCUMENTATION_NETS

    out = F.lit(False)
    for net in DOCUMENTATION_NETS:
        out = out | F.col(ip).startswith(net)
    return out
