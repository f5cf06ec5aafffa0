"""Scalar functions as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a slice's type byte, low to high.
VALID, PREDICT, SKIP, GEOMETRY_ZSTD, COLOR_ZSTD = 1, 2, 4, 8, 16
INTRA_TYPE, PREDICT_TYPE = VALID, VALID | PREDICT
PEAK_GEOMETRY, PEAK_LUMA, FRAMES_PER_SECOND = 1024.0, 256.0, 30
ZSTD_LEVELS = (-131072, 22)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rgb_to_yuv(r, g, b) -> tuple[Column, Column, Column]:
    """BT.601 of 0..255 colours."""
    r, g, b = (_col(c).cast("double") for c in (r, g, b))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    u = -0.168736 * r - 0.331264 * g + 0.5 * b + 128
    v = 0.5 * r - 0.418688 * g - 0.081312 * b + 128
    return y, u, v


def yuv_to_rgb(y, u, v, clamp: bool = True) -> tuple[Column, Column, Column]:
    """Rounded half away from zero and held within 0..255; without the clamp, as they come."""
    y, u, v = (_col(c).cast("double") for c in (y, u, v))
    out = (y + 1.402 * (v - 128), y - 0.3441 * (u - 128) - 0.7141 * (v - 128), y + 1.772 * (u - 128))
    out = tuple(F.round(c) for c in out)
    return tuple(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)).cast("int") if clamp else c for c in out)


def yuv_to_unit_rgb(y, u, v) -> tuple[Column, Column, Column]:
    """Colours of 0..1 for display, neither rounded nor held."""
    y, u, v = (_col(c).cast("double") for c in (y, u, v))
    return (y + 1.402 * (v - 128)) / 255, (y - 0.3441 * (u - 128) - 0.7141 * (v - 128)) / 255, (y + 1.772 * (u - 128)) / 255


def affine(mv: Column | str, x, y, z) -> tuple[Column, Column, Column]:
    """A row-major 4x4 matrix, an array of 16, applied to a point."""
    mv, p = _col(mv), [_col(c).cast("double") for c in (x, y, z)]
    return tuple(sum((mv[4 * i + j] * p[j] for j in range(3)), mv[4 * i + 3]) for i in range(3))


def matrix_product(a: Column | str, b: Column | str) -> Column:
    """Two row-major 4x4 arrays."""
    a, b = _col(a), _col(b)
    return F.array(*(sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)))


def matrix_inverse(mv: Column | str) -> Column:
    """The inverse of a row-major 4x4 array by its cofactors; null where it has none. mv is named often: better a stored column than an expression."""
    mv = _col(mv)

    def minor(rows: list[int], columns: list[int]) -> Column:
        (r0, r1, r2), (c0, c1, c2) = rows, columns
        at = lambda r, c: mv[4 * r + c]
        return at(r0, c0) * (at(r1, c1) * at(r2, c2) - at(r1, c2) * at(r2, c1)) - at(r0, c1) * (at(r1, c0) * at(r2, c2) - at(r1, c2) * at(r2, c0)) + at(r0, c2) * (at(r1, c0) * at(r2, c1) - at(r1, c1) * at(r2, c0))

    others = lambda i: [k for k in range(4) if k != i]
    cofactor = lambda i, j: minor(others(i), others(j)) * (-1) ** (i + j)
    whole = mv[0] * cofactor(0, 0) + mv[1] * cofactor(0, 1) + mv[2] * cofactor(0, 2) + mv[3] * cofactor(0, 3)
    return F.when(whole != 0, F.transform(F.array(*(cofactor(j, i) for i in range(4) for j in range(4))), lambda c: c / whole))


def shown_colour(value: Column | str, points: Column | str, least: int = 10) -> Column:
    """A colour from 0 to 1 as it is shown: slices of fewer points than `least` are white."""
    return F.when(_col(points) < least, F.lit(1.0)).otherwise(_col(value))


def rigid_inverse(mv: Column | str) -> Column:
    """The inverse of a rotation with a shift."""
    mv = _col(mv)
    turn = [[mv[4 * j + i] for j in range(3)] for i in range(3)]
    shift = [-(turn[i][0] * mv[3] + turn[i][1] * mv[7] + turn[i][2] * mv[11]) for i in range(3)]
    return F.array(*(c for i in range(3) for c in (*turn[i], shift[i])), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def zigzag(x: Column | str) -> Column:
    x = _col(x)
    return F.when(x >= 0, 2 * x).otherwise(-2 * x - 1)


def unzigzag(u: Column | str) -> Column:
    u = _col(u)
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u + 1, 1))


def quantize(c: Column | str, qp: Column | int) -> Column:
    """Half away from zero."""
    return F.round(_col(c) / qp).cast("long")


def dequantize(q: Column | str, qp: Column | int) -> Column:
    return _col(q) * qp


def has_bits(kind: Column | str, bits: int) -> Column:
    return _col(kind).bitwiseAND(F.lit(bits)) == bits


def set_bits(kind: Column | str, bits: int) -> Column:
    return _col(kind).bitwiseOR(F.lit(bits))


def clear_bits(kind: Column | str, bits: int) -> Column:
    return _col(kind).bitwiseAND(F.lit(0xFF & ~bits))


def octant(x, y, z, cx, cy, cz) -> Column:
    """4, 2 and 1 for each axis on the low side of the centre."""
    low = [(_col(a) <= _col(c)).cast("int") for a, c in ((x, cx), (y, cy), (z, cz))]
    return 4 * low[0] + 2 * low[1] + low[2]


def child_centre(centre: Column | str, extent: Column | str, low: Column) -> Column:
    """Of an octant along one axis; extent: of the child."""
    half = _col(extent) / 2
    return F.when(low, _col(centre) - half).otherwise(_col(centre) + half)


def tree_height(extent: Column | str, resolution: Column | float = 1.0) -> Column:
    """Levels of a tree over a cloud of this extent; one for a single place."""
    extent = _col(extent).cast("double")
    res = resolution if isinstance(resolution, Column) else F.lit(float(resolution))
    return F.when(extent > 0, power_above(extent) - power_above(res) + 1).otherwise(F.lit(1)).cast("int")


def power_above(x: Column) -> Column:
    """The least whole n with 2 ** n >= x, for x over 0; log2 of a power of two may come out beside its exponent."""
    n = F.ceil(F.log2(F.when(x > 0, x).otherwise(F.lit(1.0))))
    n = n - F.when(F.pow(F.lit(2.0), n - 1) >= x, 1).otherwise(0)
    return n + F.when(F.pow(F.lit(2.0), n) < x, 1).otherwise(0)


def haar(a, b, wa, wb) -> tuple[Column, Column]:
    """Weighted two-point transform (low, high); nothing of two empty sides."""
    a, b, wa, wb = (_col(c).cast("double") for c in (a, b, wa, wb))
    total = wa + wb
    root = F.sqrt(F.when(total > 0, total).otherwise(F.lit(1.0)))
    low = (F.sqrt(wa) * a + F.sqrt(wb) * b) / root
    high = (F.sqrt(wa) * b - F.sqrt(wb) * a) / root
    return F.when(total > 0, low).otherwise(F.lit(0.0)), F.when(total > 0, high).otherwise(F.lit(0.0))


def inverse_haar(low, high, wa, wb) -> tuple[Column, Column]:
    low, high, wa, wb = (_col(c).cast("double") for c in (low, high, wa, wb))
    total = wa + wb
    root = F.sqrt(F.when(total > 0, total).otherwise(F.lit(1.0)))
    a = (F.sqrt(wa) * low - F.sqrt(wb) * high) / root
    b = (F.sqrt(wb) * low + F.sqrt(wa) * high) / root
    return F.when(total > 0, a).otherwise(F.lit(0.0)), F.when(total > 0, b).otherwise(F.lit(0.0))


def squared_distance(a: tuple, b: tuple) -> Column:
    out = None
    for p, q in zip(a, b, strict=True):
        d = _col(p).cast("double") - _col(q).cast("double")
        out = d * d if out is None else out + d * d
    return out


def psnr(mse: Column | str, peak: float = PEAK_GEOMETRY) -> Column:
    """Decibels; null for a perfect match, whose ratio has no bound."""
    mse = _col(mse).cast("double")
    return F.when(mse > 0, 10 * F.log10(peak * peak / F.when(mse > 0, mse)))


def bitrate_mbps(size: Column | str, frames: Column | int) -> Column:
    return _col(size) * 8 * FRAMES_PER_SECOND / frames / 1e6


def frame_index(ts: Column | str, start: int, interval: int) -> Column:
    return F.floor((_col(ts) - start) / interval)


def file_name(prefix: str, ts: Column | str, index: Column | str, suffix: str) -> Column:
    return F.format_string(f"{prefix}_%04d_%04d.{suffix}", _col(ts), _col(index))


def is_file_of(path: Column | str, suffix: str) -> Column:
    return _col(path).rlike(rf"\.{suffix}$")


def zstd_level(level: Column | str) -> Column:
    return F.least(F.greatest(_col(level), F.lit(ZSTD_LEVELS[0])), F.lit(ZSTD_LEVELS[1]))
