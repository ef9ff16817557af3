"""Keyed and plain digests as native expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """The inner and outer pad of HMAC-SHA256, whose block has 64 bytes."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in k), bytes(x ^ 0x5C for x in k)


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 of a string as 64 hex digits; null for null."""
    inner, outer = hmac_pads(key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def decimal_of_hex(hexed: Column) -> Column:
    """The decimal digits of 32 hex digits. A 128-bit number overflows DECIMAL(38), so four 32-bit limbs
    are divided by 10**9 five times; each remainder gives nine digits."""
    limbs = F.array(*[F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])
    base = F.lit(10**9).cast("long")

    def divided(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("r"), F.array().cast("array<bigint>").alias("q"))
        step = lambda s, x: F.shiftleft(s["r"], 32) + x
        # floor of the exact quotient by integer arithmetic: (n - n % b) / b would go through doubles
        return F.aggregate(xs, start, lambda s, x: F.struct((step(s, x) % base).alias("r"), F.concat(s["q"], F.array(F.call_function("div", step(s, x), base))).alias("q")))

    start = F.struct(limbs.alias("limbs"), F.lit("").alias("text"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, lambda s, _: F.struct(divided(s["limbs"])["q"].alias("limbs"), F.concat(F.lpad(divided(s["limbs"])["r"].cast("string"), 9, "0"), s["text"]).alias("text")))
    return F.regexp_replace(out["text"], "^0+(?=.)", "")


def id_format_ok(col: Column) -> Column:
    """64 lower-case hex digits; false for null."""
    return F.coalesce(col.rlike("^[a-f0-9]{64}$"), F.lit(False))
