"""Scalar functions on uids, times and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multiplier of the uid hash (fixed value).
UID_PRIME = 2147482951


def uid_hash(uid: Column) -> Column:
    """The uid's halves folded together, times a prime, as a signed 32-bit number."""
    folded = F.shiftrightunsigned(uid, 32).bitwiseXOR(uid).bitwiseAND(0xFFFFFFFF)
    product = (folded.cast("decimal(20,0)") * F.lit(UID_PRIME)) % F.lit(1 << 32)
    whole = product.cast("long")
    return F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole)


def uid_bytes(uid: Column) -> Column:
    """The uid as eight bytes, least first, in lower-case hex."""
    big = F.lower(F.lpad(F.hex(uid), 16, "0"))
    return F.concat(*[F.substring(big, 15 - 2 * k, 2) for k in range(8)])


def bytes_uid(raw: Column) -> Column:
    """The uid of eight bytes in hex, least first; back from uid_bytes()."""
    big = F.concat(*[F.substring(raw, 15 - 2 * k, 2) for k in range(8)])
    return F.conv(big, 16, -10).cast("long")


def fixture_uid(text: Column) -> Column:
    """The last blank-separated part as a number, above all 32-bit ids."""
    return F.element_at(F.split(text, " "), -1).cast("long") + F.lit(2 * 2147483647)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def truncated(value: Column, digits: int = 3) -> Column:
    """Cut, not rounded, to some decimals."""
    return F.floor(value * 10**digits) / 10**digits


def second_bucket(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def iso_to_text(ts: Column) -> Column:
    """A time as dd-MMM-yyyy HH:mm:ss.000."""
    return F.date_format(ts, "dd-MMM-yyyy HH:mm:ss.'000'")
