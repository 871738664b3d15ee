"""Keyed digests and the pseudonyms made of them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hmac_sha256(key: str, value: Column) -> Column:
    """HMAC-SHA256 of a text as hexadecimal digits, from two hashes of padded keys."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ p for b in k).hex())) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def basis(patient_id: Column, name: Column) -> Column:
    """The patient's id, else the name, else unknown."""
    return F.coalesce(F.nullif(patient_id, F.lit("")), F.nullif(name, F.lit("")), F.lit("unknown"))


def pseudo_patient_id(key: str, value: Column) -> Column:
    return F.concat(F.lit("OR-"), F.upper(F.substring(hmac_sha256(key, value), 1, 12)))


def pseudo_name(key: str, value: Column) -> Column:
    return F.concat(F.lit("ANON^"), F.upper(F.substring(hmac_sha256(key, value), 1, 8)))


def let(x: Column, f) -> Column:
    """f of x, which is computed once however often f reads it."""
    return F.transform(F.array(x), f)[0]


def words_of_hex(h: Column) -> Column:
    """Thirty-two hexadecimal digits as four longs below 2**32, the highest first."""
    return F.array(*[F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def decimal_of_words(w: Column) -> Column:
    """Four words as one decimal number, which may have one digit more than a decimal column holds: sums of the words times powers of 2**32, eight digits at a time, then carries, all in longs."""
    base, places = 10**8, range(5)
    power = [[(1 << 32 * (3 - i)) // base**j % base for i in range(4)] for j in places]
    carried, out = F.lit(0).cast("long"), []
    for j in places:
        total = sum((w[i] * power[j][i] for i in range(4) if power[j][i]), carried)
        out.append(F.lpad((total % base).cast("string"), 8, "0"))
        carried = F.call_function("div", total, F.lit(base))
    return F.regexp_replace(F.concat(*out[::-1]), "^0+(?!$)", "")


def with_decimal(rows: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``, what decimal_of_words() gives of the column ``words``. Sums are columns of their own, so that each is computed once and methods stay short enough to be compiled."""
    base, places = 10**8, range(5)
    power = [[(1 << 32 * (3 - i)) // base**j % base for i in range(4)] for j in places]
    total = lambda j: F.col(f"{out}_{j}")
    for j in places:
        carried = F.call_function("div", total(j - 1), F.lit(base)) if j else F.lit(0).cast("long")
        rows = rows.withColumn(f"{out}_{j}", sum((F.col(words)[i] * power[j][i] for i in range(4) if power[j][i]), carried))
    pair = lambda j: F.substring((total(j) % base * base + total(j - 1) % base + base * base).cast("string"), 2, 16)
    digits = F.ltrim(F.concat((total(4) % base).cast("string"), pair(3), pair(1)), F.lit("0"))
    return rows.withColumn(out, F.when(digits == "", "0").otherwise(digits)).drop(*[f"{out}_{j}" for j in places])


def decimal_of_hex(h: Column) -> Column:
    return let(words_of_hex(h), decimal_of_words)


def uid_digest(key: str, value: Column) -> Column:
    """The first sixteen bytes of a UID's digest as hexadecimal digits. As a column of its own, and its words as another, each is computed once and in generated code."""
    return F.substring(hmac_sha256(key, value), 1, 32)


def uid_of_words(words: Column) -> Column:
    return F.concat(F.lit("2.25."), decimal_of_words(words))


def pseudo_uid(key: str, value: Column) -> Column:
    """2.25. and the first sixteen bytes of the digest as an integer."""
    return let(let(uid_digest(key, value), words_of_hex), uid_of_words)


def salt_date_shift(key: str) -> int:
    """Days, negative, by which a key moves dates: -(first byte of its hash mod 365) - 1."""
    return -(hashlib.sha256(key.encode()).digest()[0] % 365 + 1)
