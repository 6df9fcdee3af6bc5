"""Distance and weight kernels as column expressions over arrays of doubles, strings and small images.

All of them are built-in expressions, so they stay in the JVM and keep their place in Catalyst's plan. A NULL argument
gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is evaluated once however often f uses it; inside a lambda Spark shares no expressions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def std(a: Column) -> Column:
    """Population standard deviation."""
    return let(mean(a), lambda m: F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.nullif(F.size(a), F.lit(0))))


def standardise(a: Column) -> Column:
    return let(F.struct(mean(a).alias("m"), F.greatest(std(a), F.lit(1e-20)).alias("s")), lambda p: F.transform(a, lambda x: (x - p["m"]) / p["s"]))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def cityblock(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; a zero vector is at distance 1 of all."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 1.0).otherwise(1 - dot(a, b) / norm)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """1 - sum of minima / sum of maxima, 0 if the latter is 0."""
    low, high = (total(F.zip_with(a, b, f)) for f in (lambda x, y: F.least(x, y), lambda x, y: F.greatest(x, y)))
    return F.when(high == 0, 0.0).otherwise(1 - low / high)


def ncc(a: Column, b: Column) -> Column:
    """Mean product of two standardised arrays; 1 if both are constant."""
    constant = lambda c: F.array_min(c) == F.array_max(c)
    return F.when(constant(a) & constant(b), 1.0).otherwise(dot(a, b) / F.size(a))


#: Measures by name; those of NORMALISED standardise their arguments first.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "SSD": squared_euclidean,
    "NSSD": squared_euclidean,
    "NCClog": lambda a, b: -F.log((ncc(a, b) + 1) / 2 + 1e-10),
    "NCCone": lambda a, b: (1 - ncc(a, b)) / 2,
    "NCCplus": lambda a, b: let(ncc(a, b), lambda n: F.when(n > 0, 1 - n).otherwise(0.0)),
    "NCCplusok": lambda a, b: let(ncc(a, b), lambda n: F.when(n > 0, 1 - n).otherwise(1.0)),
    "Jaccard": weighted_jaccard,
    "NJaccard": weighted_jaccard,
    "cosine": cosine,
    "euclidean": euclidean,
    "sqeuclidean": squared_euclidean,
    "cityblock": cityblock,
    "manhattan": cityblock,
    "l1": cityblock,
    "l2": euclidean,
    "chebyshev": chebyshev,
}
NORMALISED = frozenset({"NSSD", "NCCone", "NCClog", "NCCplus", "NCCplusok"})

#: Measures of some rows of vectors with others, by numpy, for joins in blocks: the same numbers but for the last digits.
BLOCKWISE = {
    squared_euclidean: lambda x, y: ((x[:, None, :] - y[None, :, :]) ** 2).sum(2),
    euclidean: lambda x, y: np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(2)),
    cityblock: lambda x, y: np.abs(x[:, None, :] - y[None, :, :]).sum(2),
    chebyshev: lambda x, y: np.abs(x[:, None, :] - y[None, :, :]).max(2),
}

#: Ways to lay one image on another, by letter.
FLIPS = "HIVX"
#: Images that are compared with all others of a block at a time, where all ways are subtracted and squared: what numpy holds then stays near the caches.
STEP = 16


def column_means(rows: Column) -> Column:
    """Of an image, an array of rows: the mean of each column."""
    return F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda j: mean(F.transform(rows, lambda r: r[j])))


def row_means(rows: Column) -> Column:
    return F.transform(rows, mean)


def image_distance(a: Column, b: Column, measure: str, rotations: bool = False) -> Column:
    """struct(d, flip) between two images, arrays of rows.

    measure: a name in MEASURES, with suffix proj to compare column and row means, or hproj for column means alone. With
    rotations, the least over b as it is (I), upside down (V), mirrored (H) or both (X), for hproj only I and H; of equal
    distances the first letter counts. d is at least 0.
    """
    base = measure.removesuffix("hproj") if measure.endswith("hproj") else measure.removesuffix("proj")
    norm = standardise if base in NORMALISED else lambda c: c
    f = MEASURES[base]
    if measure.endswith("hproj"):
        left, right = norm(column_means(a)), norm(column_means(b))
        tries = {"I": right, "H": F.reverse(right)}
    elif measure.endswith("proj"):
        left = F.concat(norm(column_means(a)), norm(row_means(a)))
        h, v = norm(column_means(b)), norm(row_means(b))
        tries = {"I": F.concat(h, v), "V": F.concat(h, F.reverse(v)), "H": F.concat(F.reverse(h), v), "X": F.concat(F.reverse(h), F.reverse(v))}
    else:
        left = norm(F.flatten(a))
        mirrored = F.transform(b, lambda r: F.reverse(r))
        tries = {k: norm(F.flatten(r)) for k, r in {"I": b, "V": F.reverse(b), "H": mirrored, "X": F.reverse(mirrored)}.items()}
    if not rotations:
        tries = {"I": tries["I"]}
    sides = F.struct(left.alias("left"), *[r.alias(k) for k, r in tries.items()])
    best = let(sides, lambda s: F.array_min(F.array(*[F.struct(f(s["left"], s[k]).alias("d"), F.lit(k).alias("flip")) for k in tries])))
    return let(best, lambda x: F.struct(F.greatest(x["d"], F.lit(0.0)).alias("d"), x["flip"].alias("flip")))


def _standardised(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, keepdims=True), 1e-20)


def half_up(d: np.ndarray, digits: int) -> np.ndarray:
    """What Spark's round() gives: halves of the shortest decimal away from zero, and -0 as 0. Only numbers beside a half are looked at as decimals."""
    scale, out = 10.0**digits, d + 0.0
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = d * scale
        np.divide(np.rint(scaled), scale, out=out, where=np.isfinite(scaled))
        unsure = np.abs(scaled - np.floor(scaled) - 0.5) <= 4 * np.finfo(float).eps * (np.abs(scaled) + 1)
    unsure |= np.isfinite(d) & ~np.isfinite(scaled)
    if unsure.any():
        exact, unit = Context(prec=800), Decimal(1).scaleb(-digits)
        out[unsure] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP, exact)) for v in d[unsure].tolist()]
    return out + 0.0


def _least_squares(x: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The least squared Euclidean distance of each row of x to the row of each place in sides (way, place, number), and the first way that gives it.

    Matrix products find the ways that may give it, so far as their rounding can tell; only those are subtracted and squared.
    None where numbers aren't finite.
    """
    xx, yy = (x * x).sum(1), (sides * sides).sum(2)
    if not np.isfinite(xx.sum() + yy.sum()):
        return None
    rough = [yy[k] - 2 * (x @ sides[k].T) for k in range(len(sides))]  # the row's own square is the same for all
    low, way = rough[0].copy(), np.zeros(rough[0].shape, dtype=np.int8)
    for k in range(1, len(sides)):
        way[rough[k] < low] = k
        np.minimum(low, rough[k], out=low)
    low += (1e-14 * (x.shape[1] + 8) * (xx + yy.max(initial=0.0)))[:, None]  # far above the error of either way
    many = sum((r <= low).view(np.int8) for r in rough) > 1
    flat, places, d = sides.reshape(-1, sides.shape[2]), np.arange(sides.shape[1]), np.empty(low.shape)
    near = np.empty((len(places), sides.shape[2]))
    for r in range(len(x)):
        np.take(flat, way[r].astype(np.intp) * len(places) + places, axis=0, out=near, mode="clip")
        np.subtract(x[r], near, out=near)
        np.multiply(near, near, out=near)
        near.sum(1, out=d[r])
        c = np.flatnonzero(many[r])
        if len(c):
            each = ((x[r] - sides[:, c]) ** 2).sum(2)
            way[r, c] = each.argmin(0)
            d[r, c] = each.min(0)
    return d, way


def image_blocks(measure: str, rotations: bool = False) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None:
    """image_distance of some images with others, by numpy: distances and letters as places in FLIPS. None for measures that BLOCKWISE lacks."""
    base = measure.removesuffix("hproj") if measure.endswith("hproj") else measure.removesuffix("proj")
    f, norm = BLOCKWISE.get(MEASURES[base]), _standardised if base in NORMALISED else lambda x: x
    if f is None:
        return None

    def vectors(x: np.ndarray, v: int, h: int) -> np.ndarray:
        """Of images, or of what they look like upside down (v = -1) or mirrored (h = -1)."""
        if measure.endswith("hproj"):
            return norm(x.mean(1))[:, ::h]
        if measure.endswith("proj"):
            return np.concatenate([norm(x.mean(1))[:, ::h], norm(x.mean(2))[:, ::v]], 1)
        return norm(x[:, ::v, ::h].reshape(len(x), -1))

    tries = {"H": (1, -1), "I": (1, 1), "V": (-1, 1), "X": (-1, -1)}
    tries = {k: s for k, s in tries.items() if k == "I" or rotations and (s[0] == 1 or not measure.endswith("hproj"))}

    letters = np.array([FLIPS.index(k) for k in tries], dtype=np.int8)

    def plain(left: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, flip = f(left, sides[0]), np.zeros((len(left), sides.shape[1]), dtype=np.int8)
        for k in range(1, len(sides)):
            new = f(left, sides[k])
            better = (new < d) | (np.isnan(d) & ~np.isnan(new))
            d, flip = np.where(better, new, d), np.where(better, np.int8(k), flip)
        return d, flip

    def of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, sides = vectors(x, 1, 1), np.stack([vectors(y, *way) for way in tries.values()])
        got = _least_squares(left, sides) if MEASURES[base] is squared_euclidean and len(tries) > 1 else None
        if got is None:
            parts = [plain(left[lo : lo + STEP], sides) for lo in range(0, max(1, len(left)), STEP)]
            got = tuple(np.concatenate(p) for p in zip(*parts))
        return np.maximum(got[0], 0.0), letters[got[1]]

    return of


def by_image(measure: str, rotations: bool = False) -> Callable[[Column, Column], Column]:
    """image_distance by a measure, for joins in blocks too."""

    def f(a: Column, b: Column) -> Column:
        return image_distance(a, b, measure, rotations)

    f.blockwise = image_blocks(measure, rotations)
    return f


def blockwise(f: Callable) -> Callable | None:
    """What gives a measure's distances of some rows with others by numpy, if there is that."""
    return BLOCKWISE.get(f) or getattr(f, "blockwise", None)


def _same_length(a: Column, b: Column, c: Column) -> Column:
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("sequences of different length")).cast("int")).otherwise(c)


def hamming(a: Column, b: Column) -> Column:
    """Places in which two strings of equal length differ; other lengths are an error."""
    differ = F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return _same_length(a, b, F.when(F.length(a) == 0, 0).otherwise(differ))


def positional_jaccard(a: Column, b: Column) -> Column:
    """Share of places in which two strings differ; 0 for empty ones."""
    return F.when(F.length(a) == 0, 0.0).otherwise(hamming(a, b) / F.length(a))


def edit_distance(a, b) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, of which no part is edited again."""
    before, above = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, above = above, row
    return above[-1]


def damerau_levenshtein(a: Column, b: Column) -> Column:
    """edit_distance of two string columns, in Arrow batches: no built-in expression has the swap."""

    @F.pandas_udf("int")
    def of(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([None if p is None or q is None else edit_distance(p, q) for p, q in zip(x, y)], dtype="Int32")

    return of(a, b)


def weight(d: Column, bandwidth: Column | float) -> Column:
    """exp(-d * bandwidth); 0 for an infinite distance."""
    return F.exp(-d * bandwidth)


def finite(d: Column, highest: Column) -> Column:
    """An infinite distance replaced by twice the highest finite one."""
    return F.when(d == float("inf"), 2 * highest).otherwise(d)
