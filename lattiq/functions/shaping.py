"""Scalar functions as column expressions: easing, glow, colours, budgets, vectors, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattiq.operators.timelines import smootherstep, smoothstep  # noqa: F401


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def glow(step: Column, lifetime: int | Column, fade: int) -> Column:
    """1 at the start and the end of a lifetime, falling to 0 within `fade` steps."""
    fade = float(max(1, fade))
    return F.greatest(clip01(1 - step / fade), clip01(1 - (F.lit(lifetime) - step) / fade))


def glow_phases(frame: Column, n_a: int, n_b: int, n_c: int, fade: int) -> Column:
    """Glow at the start of phase A and at the end of phase C, none between."""
    fade = float(max(1, fade))
    c = frame - (n_a + n_b)
    return F.when(frame < n_a, clip01(1 - frame / fade)).when(frame < n_a + n_b, 0.0).otherwise(clip01(1 - ((n_c - 1) - c) / fade))


def life_alpha(at: Column, life: int) -> Column:
    return 1 - F.abs(2 * at / F.lit(float(life)) - 1)


def ease_out(x: Column, power: float) -> Column:
    return 1 - F.pow(1 - clip01(x), F.lit(power))


def hue_shifted(r: Column, g: Column, b: Column, shift: Column | float, brighter: Column | float = 0.0) -> Column:
    """struct(r, g, b) of a colour in [0, 1] whose hue is turned by shift (1 is a full turn) and whose brightest part is raised by `brighter`."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, (g - b) / d).when(top == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d) / 6
    h = h + shift
    h = h - F.floor(h)
    s = F.when(top == 0, 0.0).otherwise(d / top)
    if isinstance(brighter, Column) or brighter:
        top = clip01(top + brighter)

    def part(n: int) -> Column:
        k = (n + h * 6) % 6
        return top - top * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(part(5).alias("r"), part(3).alias("g"), part(1).alias("b"))


#: The colour of all columns, and how far the hue and the brightness of one may lie from it.
COLUMN_RGB, HUE_JITTER, VALUE_JITTER = (140, 195, 255), 0.04, 0.05


def column_colour(column: Column) -> Column:
    """struct(r, g, b), 0 to 255, of a column (from 1 on): the common colour, its hue and brightness moved by draws from its number; white for 0."""
    draw = lambda factor, m: (column * factor % m) / (m - 1) * 2 - 1
    c = hue_shifted(*(F.lit(v / 255) for v in COLUMN_RGB), draw(7919, 1009) * HUE_JITTER, draw(104729, 1013) * VALUE_JITTER)
    return F.struct(*(F.when(column > 0, F.bround(F.round(c[k] * 255, 9))).otherwise(255).cast("int").alias(k) for k in "rgb"))


def ramp(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear through (position, value) stops in ascending order, constant beyond them."""
    out = F.lit(float(stops[-1][1]))
    for (a, u), (b, v) in reversed(list(zip(stops[:-1], stops[1:], strict=True))):
        out = F.when(x <= b, F.lit(float(u)) + (x - a) / (b - a) * (v - u)).otherwise(out)
    return F.when(x <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def estimated_faces(n: Column) -> Column:
    """Triangles to expect from a component of n voxels: the greater of 25 n^(2/3) and 2 n."""
    return F.greatest(25 * F.pow(n, F.lit(2 / 3)), 2.0 * n)


def auto_stride(n: Column, target: Column | int | None, multiplier: float = 3.0, most: int = 6) -> Column:
    """The stride at which a component of n voxels gives about `multiplier` times the target in triangles (they fall with its
    square), rounded half to even, from 1 to `most`; 1 without a target."""
    if target is None:
        return F.lit(1).cast("bigint")
    target = target if isinstance(target, Column) else F.lit(target)
    share = estimated_faces(F.greatest(n, F.lit(1))) / (target * multiplier)
    return F.when((target <= 0) | (share <= 1), 1).otherwise(F.least(F.greatest(F.bround(F.sqrt(share)), F.lit(1)), F.lit(most))).cast("bigint")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 1e-9, F.transform(a, lambda x: x / n)).otherwise(a)


def cross(a: Column, b: Column) -> Column:
    x = lambda i, j: F.get(a, F.lit(i)) * F.get(b, F.lit(j)) - F.get(a, F.lit(j)) * F.get(b, F.lit(i))
    return F.array(x(1, 2), x(2, 0), x(0, 1))


def rotated(v: Column, axis: Column, angle: Column) -> Column:
    """v turned about a unit axis (Rodrigues)."""
    c, s, k = F.cos(angle), F.sin(angle), dot(axis, v) * (1 - F.cos(angle))
    turned = F.zip_with(F.transform(v, lambda x: x * c), F.transform(cross(axis, v), lambda x: x * s), lambda p, q: p + q)
    return F.zip_with(turned, F.transform(axis, lambda x: x * k), lambda p, q: p + q)


def upright(up: Column, forward: Column) -> Column:
    """up made orthogonal to a unit forward direction, of unit length."""
    d = dot(up, forward)
    return unit(F.zip_with(up, forward, lambda u, f: u - d * f))


def parsed_ints(text: Column) -> Column:
    """The distinct positive integers of a text in order of appearance; null in place of one beyond 64 bits."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+)"), 1), lambda x: x.try_cast("bigint")), lambda x: x.isNull() | (x > 0)))


def axis_value(text: Column, key: str) -> Column:
    """The last value of a line `key=number` (keys in either case); null without one."""
    return F.element_at(F.regexp_extract_all(text, F.lit(rf"(?im)^\s*{key}\s*=\s*(-?[0-9]+(?:\.[0-9]+)?)"), 1), -1).cast("double")


def compact(x: Column) -> Column:
    """A number in few characters: k for thousands, M for millions."""
    return F.when(F.abs(x) >= 1e6, F.format_string("%.1fM", x / 1e6)).when(F.abs(x) >= 1e3, F.format_string("%.1fk", x / 1e3)).otherwise(F.format_string("%.2f", x))


def eta(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.when(s >= 3600, F.format_string("%dh%02dm", F.expr("1") * F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
