"""The public 64-bit FarmHash fingerprint as ids (TX05); no built-in function gives it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

_M = (1 << 64) - 1
#: The algorithm's constants.
K0, K1, K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F


def _turn(v: int, by: int) -> int:
    return (v >> by | v << (64 - by)) & _M


def _mix(v: int) -> int:
    return v ^ v >> 47


def _two(u: int, v: int, mul: int) -> int:
    a = _mix((u ^ v) * mul & _M)
    return _mix((v ^ a) * mul & _M) * mul & _M


def _weak(s: bytes, at: int, a: int, b: int) -> tuple[int, int]:
    w, x, y, z = (int.from_bytes(s[at + k : at + k + 8], "little") for k in (0, 8, 16, 24))
    a = (a + w) & _M
    b = _turn((b + a + z) & _M, 21)
    c = a
    a = (a + x + y) & _M
    return (a + z) & _M, (b + _turn(a, 44) + c) & _M


def fingerprint(s: bytes) -> int:
    """The unsigned fingerprint of some bytes."""
    n = len(s)
    at = lambda k, size=8: int.from_bytes(s[k : k + size], "little")
    mul = (K2 + 2 * n) & _M
    if n == 0:
        return K2
    if n < 4:
        return _mix(((s[0] + (s[n >> 1] << 8)) * K2 ^ (n + (s[-1] << 2)) * K0) & _M) * K2 & _M
    if n < 8:
        return _two((n + (at(0, 4) << 3)) & _M, at(n - 4, 4), mul)
    if n <= 16:
        a, b = (at(0) + K2) & _M, at(n - 8)
        return _two((_turn(b, 37) * mul + a) & _M, (_turn(a, 25) + b) * mul & _M, mul)
    if n <= 64:
        a, b = at(0) * (K1 if n <= 32 else K2) & _M, at(8)
        c, d = at(n - 8) * mul & _M, at(n - 16) * K2 & _M
        y = (_turn((a + b) & _M, 43) + _turn(c, 30) + d) & _M
        z = _two(y, (a + _turn((b + K2) & _M, 18) + c) & _M, mul)
        if n <= 32:
            return z
        e, f = at(16) * mul & _M, at(24)
        g, h = (y + at(n - 32)) * mul & _M, (z + at(n - 24)) * mul & _M
        return _two((_turn((e + f) & _M, 43) + _turn(g, 30) + h) & _M, (e + _turn((f + a) & _M, 18) + g) & _M, mul)
    seed = 81
    x, y = (seed * K2 + at(0)) & _M, (seed * K1 + 113) & _M
    z = _mix((y * K2 + 113) & _M) * K2 & _M
    v = w = (0, 0)
    blocks = [(k, False) for k in range(0, (n - 1) // 64 * 64, 64)]
    for k, last in [*blocks, (n - 64, True)]:
        m, nine = ((K1 + ((z & 0xFF) << 1)) & _M, 9) if last else (K1, 1)
        if last:
            w = ((w[0] + ((n - 1) & 63)) & _M, w[1])
            v = ((v[0] + w[0]) & _M, v[1])
            w = ((w[0] + v[0]) & _M, w[1])
        x = _turn((x + y + v[0] + at(k + 8)) & _M, 37) * m & _M
        y = _turn((y + v[1] + at(k + 48)) & _M, 42) * m & _M
        x ^= w[1] * nine & _M
        y = (y + v[0] * nine + at(k + 40)) & _M
        z = _turn((z + w[0]) & _M, 33) * m & _M
        v = _weak(s, k, v[1] * m & _M, (x + w[0]) & _M)
        w = _weak(s, k + 32, (z + w[1]) & _M, (y + at(k + 16)) & _M)
        z, x = x, z
    return _two((_two(v[0], w[0], m) + _mix(y) * K0 + z) & _M, (_two(v[1], w[1], m) + x) & _M, m)


def signed(s: bytes) -> int:
    n = fingerprint(s)
    return n - (1 << 64) if n >> 63 else n


def farm_id(x: Column) -> Column:
    """The fingerprint as a signed number without its sign; null stays null."""

    @F.pandas_udf("long")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda v: None if v is None else min(abs(signed(v.encode())), (1 << 63) - 1)).astype("Int64")

    return run(x)
