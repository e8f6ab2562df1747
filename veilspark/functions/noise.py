"""Seeded noise as Column expressions: the same draw on any partitioning and any retry.

The seed is a secret. A release whose seed is known or guessable has no privacy.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh_seed(seed: str | int | None) -> str:
    """The given seed, or 128 random bits."""
    return secrets.token_hex(16) if seed is None else str(seed)


def uniform(seed: Column | str, purpose: str, *parts: Column | str) -> Column:
    """A number in (0, 1) from the hash of seed, purpose and the parts."""
    given = seed if isinstance(seed, Column) else F.lit(str(seed))
    keys = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.md5(F.concat_ws("|", given, F.lit(purpose), *keys))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def laplace(u: Column, scale: Column | float) -> Column:
    """Laplace noise by the inverse distribution function."""
    centred = u - 0.5
    return -F.signum(centred) * F.log(1 - 2 * F.abs(centred)) * scale


def gumbel(u: Column) -> Column:
    """Gumbel noise: the argmax of logit + Gumbel samples the softmax of the logits."""
    return -F.log(-F.log(u))
