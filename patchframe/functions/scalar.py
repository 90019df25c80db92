"""Column expressions shared by the operators.  Everything here stays inside Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rational approximation of erfc (Numerical Recipes,
# "erfcc"), highest power of t first.
ERFC_COEFFICIENTS = (
    0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
    -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c) -> Column:
    """Round half towards plus infinity.  ``F.round`` goes away from zero instead."""
    return F.floor(_col(c) + F.lit(0.5))


def fixed(c, digits: int = 6) -> Column:
    """Round for output and turn -0.0 into 0.0, so equal results print equally."""
    return F.round(_col(c), digits) + F.lit(0.0)


def normal_sf(z) -> Column:
    """Upper tail of the standard normal distribution."""
    z = _col(z)
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.5)
    poly = F.lit(ERFC_COEFFICIENTS[0])
    for c in ERFC_COEFFICIENTS[1:]:
        poly = poly * t + F.lit(c)
    tail = t * F.exp(poly - x * x)
    return F.when(z >= 0, tail).otherwise(F.lit(2.0) - tail) / 2


def two_sided_p(z) -> Column:
    return F.least(F.lit(1.0), normal_sf(F.abs(_col(z))) * 2)


def fisher_z_p(rho, n) -> Column:
    """p of a rank correlation by Fisher's z.

    ``n <= 3`` has no p (1).  A perfect correlation is p = 0, the limit of the
    formula, rather than the 1 a non-finite z would turn into.
    """
    rho, n = _col(rho), _col(n).cast("double")
    z = F.atanh(F.when(F.abs(rho) < 1, rho)) * F.sqrt(F.greatest(n - 3, F.lit(0.0)))
    return F.when(n <= 3, F.lit(1.0)).when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(two_sided_p(z))


def taper(dx, dy, half) -> Column:
    """Raised-cosine weight of a patch at an offset from its centre, never zero."""
    half = _col(half)

    def ramp(d):
        r = F.least(F.lit(1.0), F.abs(_col(d)) / half)
        return (F.cos(r * math.pi) + 1) * 0.5

    return ramp(dx) * ramp(dy) * 0.98 + 0.02


def saturation(r, g, b) -> Column:
    r, g, b = (_col(c).cast("double") for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, F.lit(0.0)).otherwise((top - low) / F.when(top != 0, top) * 255)


def luminance(r, g, b) -> Column:
    r, g, b = (_col(c).cast("double") for c in (r, g, b))
    return r * 0.299 + g * 0.587 + b * 0.114


def darkness(r, g, b) -> Column:
    return F.lit(255.0) - luminance(r, g, b)


def chroma(r, g, b) -> Column:
    return F.greatest(*map(_col, (r, g, b))) - F.least(*map(_col, (r, g, b)))


def sigmoid(z) -> Column:
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), _col(z)))
    return F.lit(1.0) / (F.exp(-z) + 1)


def softmax(logits) -> Column:
    """Array of logits to array of probabilities, shifted by the maximum."""
    logits = _col(logits)
    e = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def argmax_class(probs, threshold: float = 0.5) -> Column:
    """0-based winning class, null when its probability is under the threshold."""
    probs = _col(probs)
    best = F.array_max(probs)
    return F.when(best >= threshold, F.array_position(probs, best).cast("int") - 1)


def pack_rgb(r, g, b) -> Column:
    """Opaque colour as one signed 32-bit number, 0xFFRRGGBB."""
    r, g, b = (_col(c).cast("bigint") for c in (r, g, b))
    return (F.lit(255 * 2**24) + r * 65536 + g * 256 + b - F.lit(2**32)).cast("int")


def unpack_rgb(c) -> Column:
    c = _col(c).cast("bigint")
    part = lambda k: F.shiftright(c, k).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def file_dir(path) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def file_base(path) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def file_ext(path) -> Column:
    """Text after the last dot, lower case; the whole path when there is no dot."""
    return F.lower(F.regexp_extract(_col(path), r"([^.]*)$", 1))


def file_stem(path) -> Column:
    return F.regexp_replace(file_base(path), r"\.[^.]*$", "")


def slug(name) -> Column:
    s = F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.when(s == "", F.lit("class")).otherwise(s)


def patch_key(slide, model_id, level, patch_px, x, y) -> Column:
    """Identity of one encoded patch: ``slide|model|Llevel|px|x,y``."""
    xy = F.concat_ws(",", _col(x).cast("string"), _col(y).cast("string"))
    return F.concat_ws(
        "|", _col(slide), _col(model_id), F.concat(F.lit("L"), _col(level).cast("string")),
        _col(patch_px).cast("string"), xy,
    )


def obs_name(x, y) -> Column:
    return F.concat_ws("_", _col(x).cast("string"), _col(y).cast("string"))


def block_of(x, y, block_px) -> Column:
    b = F.lit(float(block_px)) if not isinstance(block_px, Column) else block_px
    return F.concat_ws(",", F.floor(_col(x) / b).cast("string"), F.floor(_col(y) / b).cast("string"))


def value_bucket(v) -> Column:
    """A coarse integer that never decreases with ``v``.

    Logarithmic, 128 steps per factor of two, mirrored for negatives.  A float32
    column has at most 65,536 distinct values per bucket whatever its
    distribution, so ordering by (bucket, value) gives exact ranks out of windows
    that are each bounded, with no sampled split points that could differ when a
    lost executor is recomputed.
    """
    v = _col(v).cast("double")
    size = F.when(F.abs(v) > 1.7e308, F.lit(300000.0)).otherwise(
        F.floor(F.log2(F.when(v != 0, F.abs(v))) * 128).cast("double") + 150000
    )
    return (
        F.when(F.isnan(v), F.lit(400000))
        .when(v == 0, F.lit(0))
        .otherwise(F.signum(v) * size)
        .cast("int")
    )
