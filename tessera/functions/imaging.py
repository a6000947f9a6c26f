"""Colour, gradient, cost and lattice expressions, and filter taps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least probability that enters a logarithm.
TINY = 1e-200


def opponent(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Red-green, yellow-blue and intensity channels."""
    return (r - g) / math.sqrt(2), (r + g - 2 * b) / math.sqrt(6), (r + g + b) / math.sqrt(3)


#: sRGB to CIE XYZ, and the D65 white point (fixed values).
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """CIE XYZ of 8-bit sRGB."""
    line = [F.when(c <= 0.04045 * 255, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    return tuple(sum((F.lit(k) * c for k, c in zip(row[1:], line[1:], strict=True)), F.lit(row[0]) * line[0]) for row in XYZ)


def _lightness(t: Column) -> Column:
    return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE 1976 L*a*b*."""
    x, y, z = (_lightness(c / w) for c, w in zip(xyz(r, g, b), WHITE, strict=True))
    return y * 116 - 16, (x - y) * 500, (y - z) * 200


def luv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE 1976 L*u*v*; black has no chroma."""
    x, y, z = xyz(r, g, b)
    light = _lightness(y) * 116 - 16
    total, white = x + y * 15 + z * 3, WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
    chroma = lambda c, n: F.coalesce(light * 13 * (F.try_divide(c, total) - n / white), F.lit(0.0))
    return light, chroma(x * 4, 4 * WHITE[0]), chroma(y * 9, 9 * WHITE[1])


def confidence(*bands: Column) -> Column:
    """1 at mid grey, falling to 0 with the mean distance of the bands from it."""
    far = sum((F.abs(c - 128) / 128 for c in bands[1:]), F.abs(bands[0] - 128) / 128)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - far / len(bands)))


def threshold_colour(p: Column, least: float = 0.5) -> Column:
    """The word for a probability: green past ``least``, red else."""
    return F.when(p > least, "green").otherwise("red")


def to_u8(p: Column, rounding: bool = False) -> Column:
    """A probability as a byte: truncated as array casts do, or rounded and saturated."""
    scaled = p * 255
    return (F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(scaled))) if rounding else F.floor(scaled)).cast("int")


def logloss(p: Column) -> Column:
    """-ln p, guarded against zero."""
    return -F.log(F.greatest(p, F.lit(TINY)))


def softmax_costs(scores: Column, factor: float = 1.0) -> Column:
    """array: -factor * ln softmax of each score; the largest is taken off first."""
    top = F.array_max(scores)
    total = F.aggregate(F.transform(scores, lambda s: F.exp(s - top)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(scores, lambda s: F.lit(-factor) * (s - top - F.log(total)))


def angle_bins(dx: Column, dy: Column, bins: int, full_circle: bool = False) -> tuple[Column, Column, Column, Column]:
    """(lower bin, its mass, upper bin, its mass) of a gradient, split linearly between two bins."""
    size = F.sqrt(dx * dx + dy * dy)
    turn = 2 * math.pi if full_circle else math.pi
    angle = F.atan2(dy, dx)
    angle = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle) * (bins / turn)
    low = F.floor(angle)
    return F.pmod(low, F.lit(bins)).cast("int"), (low + 1 - angle) * size, F.pmod(low + 1, F.lit(bins)).cast("int"), (angle - low) * size


def l2_unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d)


def kl_divergence(a: Column, b: Column) -> Column:
    """Sum of a ln(a / b) where both are positive."""
    term = F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), x * F.log(x / y)).otherwise(F.lit(0.0)))
    return F.aggregate(term, F.lit(0.0), lambda acc, d: acc + d)


def lattice_cell(v: Column, low: float, high: float, buckets: int) -> Column:
    """Bucket of a value; the highest value falls into the last one."""
    cell = F.floor((v - low) * buckets / (high - low))
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), cell)).cast("int")


def lattice_bucket(cells: Sequence[Column], buckets: Sequence[int]) -> Column:
    """One number for a cell of several dimensions."""
    out = cells[0]
    for c, b in zip(cells[1:], buckets[1:], strict=True):
        out = out * b + c
    return out


# --- filter taps ---------------------------------------------------------------------------------


def _places(sigma: float) -> range:
    c = int(3 * sigma)
    return range(-c, c + 1)


def gaussian(sigma: float) -> list[float]:
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in _places(sigma)]
    return [x / sum(raw) for x in raw]


def gaussian_slope(sigma: float) -> list[float]:
    scale = math.sqrt(2 * math.pi) * sigma**3
    return [-k * math.exp(-k * k / (2 * sigma * sigma)) / scale for k in _places(sigma)]


def gaussian_curvature(sigma: float) -> list[float]:
    """Second derivative, its mean taken off so that flat images answer zero."""
    scale = math.sqrt(2 * math.pi) * sigma**5
    raw = [(k * k - sigma * sigma) * math.exp(-k * k / (2 * sigma * sigma)) / scale for k in _places(sigma)]
    return [x - sum(raw) / len(raw) for x in raw]


def texton_bank(scale: float = 1.0) -> list[tuple[str, int, list[float], list[float]]]:
    """(name, band, taps along x, taps along y) of the 17 responses of the texton filter bank; a Laplacian
    is the sum of its two entries."""
    out = [(f"gauss{s}_{band}", band, gaussian(s * scale), gaussian(s * scale)) for s in (1, 2, 4) for band in range(3)]
    for s in (1, 2, 4, 8):
        out += [(f"log{s}", 0, gaussian_curvature(s * scale), gaussian(s * scale)), (f"log{s}", 0, gaussian(s * scale), gaussian_curvature(s * scale))]
    for s in (2, 4):
        out += [(f"dx{s}", 0, gaussian_slope(s * scale), gaussian(3 * s * scale)), (f"dy{s}", 0, gaussian(3 * s * scale), gaussian_slope(s * scale))]
    return out


# --- approximate kernel maps -----------------------------------------------------------------------


def hellinger(w: float) -> float:
    return 1.0 if w == 0 else 0.0


def chi2(w: float) -> float:
    return 1 / math.cosh(math.pi * w)


def intersection(w: float) -> float:
    return 2 / (math.pi * (1 + 4 * w * w))


def jensen_shannon(w: float) -> float:
    return 2 / (math.pi * math.log(4) * (1 + 4 * w * w) * math.cosh(math.pi * w))


SPECTRA = {"hellinger": hellinger, "chi2": chi2, "intersection": intersection, "jensen_shannon": jensen_shannon}


def kernel_map(x: Column, spectrum, count: int, step: float) -> Column:
    """array of ``count`` features whose dot product approximates the kernel (phase in x itself):
    the constant one, then cosine and sine of each multiple of ``step``."""
    cells = [F.sqrt(F.abs(F.lit(spectrum(0.0)) * x))]
    for i in range(1, count):
        j = (i + 1) // 2
        size = F.sqrt(F.abs(F.lit(2.0) * x * step * spectrum(j * step)))
        cells.append(size * (F.cos if i % 2 else F.sin)(F.lit(j * step) * x))
    return F.array(*cells)
