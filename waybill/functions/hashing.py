"""Hashes by column expressions: FNV-1a, signed bins, HMAC, generation seeds; FNV-1a of many strings at once in tasks."""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 64 bit.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
_HALF = 1 << 32
_PRIME_LOW, _PRIME_HIGH = FNV_PRIME % _HALF, FNV_PRIME // _HALF


def byte_values(text: Column) -> Column:
    """UTF-8 bytes as integers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(digits) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def fnv1a(text: Column) -> Column:
    """(high, low) 32-bit halves of the hash; a 64-bit product would overflow under ANSI rules."""

    def step(acc: Column, byte: Column) -> Column:
        low = acc["low"].bitwiseXOR(byte)
        product = low * _PRIME_LOW
        high = (acc["high"] * _PRIME_LOW + low * _PRIME_HIGH + F.shiftrightunsigned(product, 32)) % _HALF
        return F.struct(high.alias("high"), product.bitwiseAND(F.lit(_HALF - 1)).alias("low"))

    start = F.struct(F.lit(FNV_OFFSET // _HALF).cast("bigint").alias("high"), F.lit(FNV_OFFSET % _HALF).cast("bigint").alias("low"))
    return F.aggregate(byte_values(text), start, step)


def signed_bin(text: Column, bins: int) -> Column:
    """(bin, sign): the low bits choose the bin, the top bit the sign."""
    h = fnv1a(text)
    return F.struct((h["low"] % bins).alias("bin"), F.when(h["high"] >= _HALF // 2, -1).otherwise(1).alias("sign"))


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column; the secret has at most 64 bytes."""
    if len(secret) > 64:
        raise ValueError("the secret has more than 64 bytes")
    key = secret.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def audit_token(secret: bytes, domain: str, position: Column, episode_id: Column) -> Column:
    """HMAC of the domain, the position as eight bytes, a zero byte and the id."""
    place = F.unhex(F.lpad(F.hex(position.cast("bigint")), 16, "0"))
    message = F.concat(F.encode(F.lit(domain), "UTF-8"), place, F.unhex(F.lit("00")), F.encode(episode_id, "UTF-8"))
    return hmac_sha256(secret, message)


def generation_seed(*fields: Column) -> Column:
    """The first four bytes of the SHA-256 of the fields joined by NUL."""
    joined = F.concat_ws("\0", *[f.cast("string") for f in fields])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("bigint")


def fnv1a_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a of many byte ranges of one buffer, going on from a state for each; the longest ranges go first, so each step touches those that still have a byte."""
    size = ends - starts
    most = int(size.max(initial=0))
    # keys of two bytes are sorted by counting
    order = np.argsort((most - size).astype(np.uint16) if most < 1 << 16 else -size, kind="stable")
    out, at, left = state[order], starts[order], size[order]
    active = len(order)
    for step in range(int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left[:active], -step, "left"))
        out[:active] = (out[:active] ^ data[at[:active] + step]) * np.uint64(FNV_PRIME)
    back = np.empty_like(out)
    back[order] = out
    return back


def fnv1a_of(prefix: bytes, state: int = FNV_OFFSET) -> int:
    for b in prefix:
        state = (state ^ b) * FNV_PRIME % (1 << 64)
    return state
