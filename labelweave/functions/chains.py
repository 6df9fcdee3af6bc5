"""Chain codes: boundaries as strings of the digits 0 to 7, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps in x and y of each code; fixed values of the eight-connected convention.
DX, DY = (1, 1, 0, -1, -1, -1, 0, 1), (0, 1, 1, 1, 0, -1, -1, -1)
#: Codes by 3 * (step in the first coordinate) + step in the second + 4; fixed values.
BY_STEP = (5, 6, 7, 4, -1, 0, 3, 2, 1)
#: What codes become when mirrored left to right, and upside down; fixed values.
MIRRORED, UPSIDE_DOWN = "43210765", "07654321"
CODES = "01234567"


def _error(text: str) -> Column:
    return F.raise_error(F.lit(text)).cast("int")


def from_boundary(points: Column) -> Column:
    """Array of codes of a closed boundary, an array of struct(a, b) of integer coordinates.

    A last point equal to the first goes; other steps of length 0, or of more than one pixel, are errors.
    """
    n = F.size(points)
    at = lambda i: F.get(points, i % n)
    step = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((at(i + 1)["a"] - at(i)["a"]).alias("a"), (at(i + 1)["b"] - at(i)["b"]).alias("b")))
    step = F.filter(step, lambda s, i: ~((i == n - 1) & (s["a"] == 0) & (s["b"] == 0)))
    by_step = F.array(*map(F.lit, BY_STEP))
    return F.transform(
        step,
        lambda s: F.when(F.greatest(F.abs(s["a"]), F.abs(s["b"])) > 1, _error("a step is not 8-connected"))
        .when((s["a"] == 0) & (s["b"] == 0), _error("two points in a row are the same"))
        .otherwise(F.get(by_step, 3 * s["a"] + s["b"] + 4)),
    )


def to_string(codes: Column) -> Column:
    return F.array_join(codes.cast("array<string>"), "")


def from_string(s: Column) -> Column:
    digits = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)).cast("int"))
    return F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(digits)


def unwrapped(codes: Column) -> Column:
    """Each code shifted by a multiple of 8 to come closest to the one before; of two as close, the even multiple."""
    def add(acc: Column, c: Column) -> Column:
        return F.array_append(acc, F.when(F.size(acc) == 0, c).otherwise(c + 8 * F.bround((F.get(acc, F.size(acc) - 1) - c) / 8.0).cast("int")))

    return F.aggregate(codes, F.array().cast("array<int>"), add)


def coordinates(codes: Column, x: Column | float = 0.0, y: Column | float = 0.0) -> Column:
    """Array of struct(x, y): the start and the place after each code."""
    dx, dy = (F.array(*map(F.lit, d)) for d in (DX, DY))
    start = F.array(F.struct((F.lit(0.0) + x).alias("x"), (F.lit(0.0) + y).alias("y")))

    def add(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.array_append(acc, F.struct((last["x"] + F.get(dx, c)).alias("x"), (last["y"] + F.get(dy, c)).alias("y")))

    return F.aggregate(codes, start, add)


def _drift(s: Column, steps: tuple[int, ...]) -> Column:
    """End minus start along one axis, from how often each code occurs."""
    count = lambda k: F.length(s) - F.length(F.replace(s, F.lit(str(k)), F.lit("")))
    parts = [count(k) * d for k, d in enumerate(steps) if d]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def normalised(s: Column) -> Column:
    """A code string mirrored so that it ends to the right of its start, and turned so that it ends above it."""
    x = F.when(_drift(s, DX) < 0, F.translate(s, CODES, MIRRORED)).otherwise(s)
    return F.when(_drift(s, DY) < 0, F.translate(x, CODES, UPSIDE_DOWN)).otherwise(x)


def training_words(s: Column, n: int, repeat_first: bool = True) -> Column:
    """Windows of n characters round a closed string; by default the first one counts twice, as the method's authors count."""
    return F.transform(F.sequence(F.lit(1), F.length(s) + int(repeat_first)), lambda i: F.substring(F.concat(s, F.substring(s, 1, n)), i, F.lit(n)))


def projection_words(s: Column, n: int) -> Column:
    """The same windows, each once."""
    return training_words(s, n, False)


def feature_name(scale: Column, word: Column) -> Column:
    return F.format_string("s%02di%03d", scale, word)
