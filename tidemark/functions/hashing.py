"""Hashes of tokens, categories and rows, as expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 1_000_000
#: A Mersenne prime: bucket locations are taken modulo it first.
PRIME = 2**31 - 1


def _hex(text: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(text, start, n), 16, 10).cast("bigint")


def hash_token(token: Column, bins: int = BINS) -> Column:
    """The MD5 digest as an unsigned number modulo ``bins - 1``, plus 1."""
    return hash_digest(F.md5(token), bins)


def hash_tokens(tokens: list[Column], bins: int = BINS) -> Column:
    """``hash_token`` of several columns, as one array.

    The digits of a digest cost Spark's expressions more than the digest, so batches of rows are hashed
    in Python, and of a batch each column's different tokens only.
    """

    def hashed(*columns: pa.Array) -> pa.Array:
        out, missing = (np.zeros((len(columns[0]), len(columns)), t) for t in (np.int64, bool))
        for k, c in enumerate(columns):
            d = c.dictionary_encode()
            each = [int.from_bytes(hashlib.md5(x.encode()).digest()) % (bins - 1) + 1 for x in d.dictionary.to_pylist()]
            missing[:, k] = c.is_null()
            out[:, k] = np.array([*each, 0])[d.indices.fill_null(len(each)).to_numpy()]
        ends = np.arange(len(out) + 1, dtype=np.int32) * len(columns)
        return pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1), mask=missing.reshape(-1)))

    return F.arrow_udf(hashed, "array<bigint>")(*tokens)


def hash_digest(digest: Column, bins: int = BINS) -> Column:
    rest = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        rest = (rest * F.lit(2**32) + _hex(digest, start, 8)) % F.lit(bins - 1)
    return rest + 1


def hash_profile_token(token: Column) -> Column:
    """As ``hash_token`` of ``group-`` and the token, but the digest is a double first."""
    digest = F.md5(F.concat(F.lit("group-"), token))
    hexadecimal = F.concat(F.lit("0x"), digest, F.lit("p0")).cast("double")
    return (hexadecimal % F.lit(999999.0) + 1).cast("bigint")


def category_hash(value: Column, seed: int) -> Column:
    """A seeded signed 64-bit hash of the value's text."""
    return F.xxhash64(value.cast("string"), F.lit(seed))


def bucket_location(value: Column, coefficients: tuple[int, int, int, int], offset: int, buckets: int) -> Column:
    """One location: the value's four bit fields (21, 21, 21, 1) times the coefficients, plus the offset."""
    low = (1 << 21) - 1
    parts = [F.shiftright(value, s).bitwiseAND(F.lit(m)) for s, m in ((0, low), (21, low), (42, low), (63, 1))]
    total = F.lit(offset)
    for part, c in zip(parts, coefficients, strict=True):
        total = total + part * F.lit(c)
    return F.pmod(F.pmod(total, F.lit(PRIME)), F.lit(buckets))


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once, however often ``of`` names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _times(x: Column, constant: int) -> Column:
    """Product modulo 2**64 of two 64-bit patterns; no step passes 63 bits but by shifts (overflow raises otherwise)."""
    low, small = F.lit((1 << 32) - 1), F.lit((1 << 16) - 1)
    x0, x1 = x.bitwiseAND(low), F.shiftrightunsigned(x, 32)
    c0, c1 = constant & 0xFFFFFFFF, constant >> 32

    def cross(half: Column, c: int) -> Column:  # modulo 2**32
        return (half * F.lit(c & 0xFFFF)).bitwiseAND(low) + F.shiftleft((half * F.lit(c >> 16)).bitwiseAND(small), 16)

    # x0 * c0 is top * 2**16 and the 16 lowest bits of x0's lower half times c0
    def joined(lowest: Column) -> Column:
        top = F.shiftrightunsigned(x0, 16) * F.lit(c0) + F.shiftrightunsigned(lowest, 16)
        upper = F.shiftrightunsigned(top, 16) + cross(x0, c1) + cross(x1, c0)
        return F.shiftleft(upper, 32).bitwiseOR(F.shiftleft(top.bitwiseAND(small), 16)).bitwiseOR(lowest.bitwiseAND(small))

    return _let(x0.bitwiseAND(small) * F.lit(c0), joined)


def row_masked(row: Column, basis_points: int) -> Column:
    """Whether the row number's SplitMix64 value, unsigned modulo 10000, is below ``basis_points``.

    Each step's value is bound once: named in the next step's text instead, it would be worked out
    some thousand times a row.
    """
    golden, first, second = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    low = F.lit((1 << 32) - 1)
    mixed = lambda v, n: _let(v, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, n)))
    times = lambda v, c: _let(v, lambda x: _times(x, c))

    def plus(r: Column) -> Column:
        under = r.bitwiseAND(low) + F.lit(golden & 0xFFFFFFFF)
        upper = F.shiftrightunsigned(r, 32) + F.lit(golden >> 32) + F.shiftrightunsigned(under, 32)
        return F.shiftleft(upper, 32).bitwiseOR(under.bitwiseAND(low))

    def below(v: Column) -> Column:
        return (F.shiftrightunsigned(v, 1) % 5000) * 2 + v.bitwiseAND(F.lit(1).cast("bigint")) < basis_points

    v = _let(row.cast("bigint"), plus)
    v = times(mixed(v, 30), first)
    v = times(mixed(v, 27), second)
    return _let(mixed(v, 31), below)
