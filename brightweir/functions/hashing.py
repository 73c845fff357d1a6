"""Hashing of ids inside Spark expressions.

An id's UTF-8 bytes are one big unsigned integer x; the hash family is
``((a*x + b) % p) % m``. Ids are far wider than 64 bits, so x is reduced modulo p
over chunks of five bytes, which keeps every product inside a bigint.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Primes and sizes of the sketches.
BLOOM_PRIMES = (50021, 50023, 50033, 50047, 50051, 50069, 50077, 50087, 50093, 50101)
BLOOM_BITS = 69997
DISTINCT_PRIMES = (997, 991, 983, 977, 971, 967, 953, 947, 941, 937)
VARIANT_PRIME = 69997
VARIANT_MODULUS = 1919
VARIANT_HASHES = 7

CHUNK_HEX = 10
CHUNK_BASE = 1 << 40


@dataclass(frozen=True)
class HashSpec:
    """One member of the family ``((a*x + b) % p) % m``."""

    a: int
    b: int
    p: int
    m: int


def draw(text: str) -> int:
    """Reproducible 32-bit number: the first eight hex digits of md5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def wide_draw(text: str) -> int:
    """Reproducible 64-bit number: the first sixteen hex digits of md5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:16], 16)


def draw_column(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def md5_bucket(key: Column, n: int) -> Column:
    """Engine-independent bucket of a key in ``0..n-1``."""
    return draw_column(key.cast("string")) % n


def family(tag: str, primes, m: int) -> list[HashSpec]:
    """One hash per prime, a and b drawn from 1..p-1 by rule."""
    return [
        HashSpec(1 + draw(f"{tag}-a-{i}") % (p - 1), 1 + draw(f"{tag}-b-{i}") % (p - 1), p, m)
        for i, p in enumerate(primes)
    ]


def bloom_family() -> list[HashSpec]:
    return family("bloom", BLOOM_PRIMES, BLOOM_BITS)


def distinct_family() -> list[HashSpec]:
    return family("distinct", DISTINCT_PRIMES, BLOOM_BITS)


def variant_family() -> list[HashSpec]:
    return family("variant", [VARIANT_PRIME] * VARIANT_HASHES, VARIANT_MODULUS)


def id_chunks(id_col: Column) -> Column:
    """Array of five-byte chunks of the id, most significant first."""
    digits = F.hex(F.encode(id_col.cast("string"), "UTF-8"))
    n_chunks = F.greatest(F.lit(1), F.ceil(F.length(digits) / CHUNK_HEX).cast("int"))
    padded = F.lpad(digits, n_chunks * CHUNK_HEX, F.lit("0"))
    return F.transform(
        F.sequence(F.lit(0), n_chunks - 1),
        lambda i: F.conv(F.substring(padded, i * CHUNK_HEX + 1, CHUNK_HEX), 16, 10).cast("bigint"),
    )


def chunks_mod(chunks: Column, p: int) -> Column:
    return F.aggregate(
        chunks, F.lit(0).cast("bigint"), lambda acc, c: (acc * (CHUNK_BASE % p) + c) % p
    )


def hash_chunks(chunks: Column, spec: HashSpec) -> Column:
    reduced = chunks_mod(chunks, spec.p)
    return ((reduced * spec.a + spec.b) % spec.p) % spec.m


def hash_all(chunks: Column, specs: list[HashSpec]) -> Column:
    """Array with one hash value per spec."""
    return F.array(*[hash_chunks(chunks, s) for s in specs])


def linear_hash(index: Column, a: int, b: int, m: int) -> Column:
    """``(index * a + b) % m`` for m below 2^46, in halves of a, so that no product leaves a bigint."""
    half = 1 << 16
    x = index.cast("bigint") % m
    if m < 1 << 31:
        return (x * a + b) % m
    out = F.lit(0).cast("bigint")
    for digit in reversed([a >> (16 * i) & (half - 1) for i in range(3)]):
        out = (out * half + x * digit) % m
    return (out + b) % m


def minhash_coefficients(n: int, m: int) -> list[tuple[int, int]]:
    """n pairs (a, b) with 1 <= a < m and 0 <= b < m, drawn by rule; for a modulus beyond 32 bits from wider draws."""
    pick = draw if m <= 1 << 32 else wide_draw
    return [(1 + pick(f"minhash-a-{i}") % (m - 1), pick(f"minhash-b-{i}") % m) for i in range(n)]
