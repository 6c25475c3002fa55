"""Which kind of IP address a text is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9A-Fa-f]{1,4}"
_TAIL = rf"(?:{_H}:{_H}|{_V4})"
_ZERO = r"0{1,4}"

IPV4 = rf"\A{_V4}\z"

# The nine forms of the address grammar: no "::", then "::" ever further right.
IPV6 = (
    r"\A(?:"
    + "|".join(
        [rf"(?:{_H}:){{6}}{_TAIL}"]
        + [rf"(?:(?:{_H}:){{0,{max(4 - n, 0)}}}{_H})?::(?:{_H}:){{{n}}}{_TAIL}" for n in range(4, -1, -1)]
        + [rf"::(?:{_H}:){{5}}{_TAIL}", rf"(?:(?:{_H}:){{0,5}}{_H})?::{_H}", rf"(?:(?:{_H}:){{0,6}}{_H})?::"]
    )
    + r")\z"
)

# An IPv4 address written as IPv6: five zero groups, ffff, then the address.
MAPPED = (
    r"\A(?:"
    + rf"(?:{_ZERO}:){{5}}[Ff]{{4}}:{_TAIL}"
    + rf"|(?:{_ZERO}(?::{_ZERO}){{0,4}})?::(?:{_ZERO}:){{0,4}}[Ff]{{4}}:{_TAIL}"
    + rf"|(?:{_ZERO}:){{5}}[Ff]{{4}}:(?::|{_H}::|:{_ZERO})"
    + r")\z"
)


def ip_version(ip: Column) -> Column:
    """``v4`` for an IPv4 or IPv4-mapped address, ``v6`` for another, else ``""``."""
    return (
        F.when(ip.rlike(IPV4), "v4")
        .when(ip.rlike(IPV6) & ip.rlike(MAPPED), "v4")
        .when(ip.rlike(IPV6), "v6")
        .otherwise("")
    )
