"""Random draws as functions of row keys.

A draw is the md5 of ``seed:salt:key...``. It does not depend on partitioning, task retries or
executor loss, and any SQL engine with md5 gives the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# 2**32 + 1: eight hex digits plus one, divided by this, lie strictly between 0 and 1.
_UNIFORM_SPAN = 4294967297.0
# Draws of 16 hex digits that one sha256 digest holds.
WORDS_PER_DIGEST = 4
_WORD_DIGITS = 16


def draw_hash(seed: int, salt: str, *keys: Column | str) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[c.cast("string") for c in cols]))


def hex_word(h: Column, slot: int = 0) -> Column:
    """The slot-th group of eight hex digits as a whole number (slots 0 to 3)."""
    return F.conv(F.substring(h, 8 * slot + 1, 8), 16, 10).cast("bigint")


def uniform(h: Column, slot: int = 0) -> Column:
    return (hex_word(h, slot) + F.lit(1)) / F.lit(_UNIFORM_SPAN)


def gaussian(h: Column) -> Column:
    """Standard normal by Box-Muller from the first two words of the hash."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform(h, 0))) * F.cos(F.lit(2.0 * math.pi) * uniform(h, 1))


def draw_index(h: Column, n: Column) -> Column:
    """A number from 0 to n-1; null where n is 0 or null."""
    return F.when(n > 0, F.pmod(hex_word(h, 0), n))


def hash_bucket(h: Column, digits: int = 4) -> Column:
    """Leading hex digits of the hash: 16**digits buckets that follow the order of the hash itself."""
    return F.substring(h, 1, digits)


def round_digests(seed: int, salt: str, rounds: int, *keys: Column | str) -> dict[str, Column]:
    """The digests that draws of so many rounds need, as columns to be added first."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    out = {}
    for i in range(-(-rounds // WORDS_PER_DIGEST)):
        parts = [F.lit(str(seed)), F.lit(salt), F.lit(str(i)), *[c.cast("string") for c in cols]]
        out[f"_digest{i}"] = F.sha2(F.concat_ws(":", *parts), 256)
    return out


def round_draws(rounds: int) -> Column:
    """One draw of 16 hex digits per round, as an array over the columns of ``round_digests``."""
    return F.array(
        *[
            F.substring(f"_digest{r // WORDS_PER_DIGEST}", _WORD_DIGITS * (r % WORDS_PER_DIGEST) + 1, _WORD_DIGITS)
            for r in range(rounds)
        ]
    )


def draw_level(h: Column) -> Column:
    """Number of leading zero digits: each level holds about a sixteenth of the rows of the one before.

    A smaller draw never has a smaller level, so "the q smallest draws of a group" all lie at or above
    the highest level that, with those above it, still holds q rows.
    """
    return F.length(h) - F.length(F.ltrim(h, F.lit("0")))
