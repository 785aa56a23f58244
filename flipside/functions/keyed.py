"""Keyed random columns: every draw is a pure function of (seed, row key, salt).

A draw never depends on partitioning, task order or retries, and the same
value can be rebuilt outside Spark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 4294967296.0  # 2**32: the first 8 hex digits of a digest
_UNIT = 9007199254740992.0  # 2**53: doubles of [0,1) on an even grid


def _col(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def draw_tag(*parts) -> int:
    """The plain values of a key as one signed 64-bit number."""
    text = "|".join(str(p) for p in parts)
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big", signed=True)


def uniform01(*parts) -> Column:
    """U[0,1) with 53 bits for keys made of plain values and integer Columns.

    Plain values (seed, feature, purpose) are folded into one constant when
    the plan is built; per row only a 64-bit hash of the integer columns is
    computed, inside generated code.
    """
    tag = draw_tag(*[p for p in parts if not isinstance(p, Column)])
    ints = [p.cast("long") for p in parts if isinstance(p, Column)]
    return F.shiftrightunsigned(F.xxhash64(F.lit(tag), *ints), 11).cast("double") / F.lit(_UNIT)


def key_hash(*parts) -> Column:
    """32 hex digits of the joined key; `parts` are Columns of any type or plain values."""
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))


def text_uniform01(*parts) -> Column:
    """U[0,1) with 32 bits for keys that hold text, such as dataset names.

    Several times slower than `uniform01`; meant for one draw per group.
    """
    return F.conv(F.substring(key_hash(*parts), 1, 8), 16, 10).cast("double") / F.lit(_RANGE)


def rand_uniform(low: float, high: float, *parts) -> Column:
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * uniform01(*parts)


def rand_normal(mu: float, sd: float, *parts) -> Column:
    """Box-Muller on two keyed uniforms; 1-u keeps the logarithm finite."""
    u1 = uniform01(*parts, "a")
    u2 = uniform01(*parts, "b")
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.lit(float(mu)) + F.lit(float(sd)) * z


def rand_sign(*parts) -> Column:
    return F.when(uniform01(*parts) > F.lit(0.5), F.lit(1.0)).otherwise(F.lit(-1.0))


def rand_int(low: int, high: int, *parts) -> Column:
    """Integer in [low, high)."""
    return (F.lit(int(low)) + F.floor(uniform01(*parts) * F.lit(float(high - low)))).cast("int")


def rand_int_rounded(low: float, high: float, *parts) -> Column:
    """round(U(low, high)): both end values get half the mass of the others."""
    return F.floor(rand_uniform(low, high, *parts) + F.lit(0.5)).cast("int")


def cumulative(weights: Sequence[float]) -> list[float]:
    total = float(sum(weights))
    out, acc = [], 0.0
    for w in weights:
        acc += float(w) / total
        out.append(acc)
    out[-1] = 1.0
    return out


def rand_choice(weights: Sequence[float], *parts) -> Column:
    """0-based category drawn with the given weights."""
    u = uniform01(*parts)
    picked = F.lit(len(weights) - 1)
    for i, edge in reversed(list(enumerate(cumulative(weights)[:-1]))):
        picked = F.when(u < F.lit(edge), F.lit(i)).otherwise(picked)
    return picked.cast("int")


def zipf_weights(a: float, low: int, high: int) -> list[float]:
    return [float(x) ** (-a) for x in range(low, high)]


def rand_zipf(a: float, low: int, high: int, *parts) -> Column:
    """Bounded Zipf on [low, high)."""
    return (F.lit(int(low)) + rand_choice(zipf_weights(a, low, high), *parts)).cast("int")


def softmax_weights(tail: Sequence[float]) -> list[float]:
    """softmax([1, *tail]): the given weights are logits, the first source has logit 1."""
    logits = [1.0, *[float(w) for w in tail]]
    top = max(logits)
    exps = [math.exp(v - top) for v in logits]
    return [e / sum(exps) for e in exps]
