"""Expressions on array columns: label algebra, reductions, distances, selections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gather(array: Column, places: list[int]) -> Column:
    """The elements at the given places (from 0)."""
    return F.array(*[F.get(array, i) for i in places])


def reduce_flags(flags: Column, how: str = "any", least: int | None = None) -> Column:
    """any, all, none, min (at least ``least`` true) or max (at most ``least`` true) of an array of booleans."""
    n_true = F.size(F.filter(flags, lambda x: x))
    return {
        "any": lambda: F.exists(flags, lambda x: x),
        "all": lambda: F.forall(flags, lambda x: x),
        "none": lambda: ~F.exists(flags, lambda x: x),
        "min": lambda: n_true >= least,
        "max": lambda: n_true <= least,
    }[how]()


def positive(array: Column) -> Column:
    return F.transform(array, lambda x: x > 0)


def clip(array: Column, left: int, right: int) -> Column:
    """Elements left..right-1 (from 0)."""
    return F.slice(array, left + 1, right - left)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def _low(x: Column, y: Column) -> Column:
    return F.least(x, y)


def _high(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, even inside a lambda over the row's array."""
    return F.get(F.transform(F.array(value), use), 0)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def generalised_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima; 0 where the latter is 0."""
    low, high = total(F.zip_with(a, b, _low)), total(F.zip_with(a, b, _high))
    return F.coalesce(F.try_divide(low, high), F.lit(0.0))


def signed_jaccard(a: Column, b: Column) -> Column:
    """Positive and negative parts compared on their own, then averaged over those parts that exist."""

    def part(x: Column, sign: int) -> Column:
        return F.transform(x, lambda v: F.greatest(v.cast("double") * sign, F.lit(0.0)))

    low = total(F.zip_with(part(a, 1), part(b, 1), _low)) + total(F.zip_with(part(a, -1), part(b, -1), _low))
    high = total(F.zip_with(part(a, 1), part(b, 1), _high)) + total(F.zip_with(part(a, -1), part(b, -1), _high))
    return F.coalesce(F.try_divide(low, high), F.lit(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of one length; null without variance."""
    n, sa, sb = F.size(a), total(a), total(b)
    cov = n * dot(a, b) - sa * sb
    return F.try_divide(cov, F.sqrt((n * dot(a, a) - sa * sa) * (n * dot(b, b) - sb * sb)))


def row_max_normalised(array: Column) -> Column:
    """x / max, 0 where the maximum is 0."""
    return _once(
        F.array_max(array).cast("double"),
        lambda top: F.transform(array, lambda x: F.when(top == 0, 0.0).otherwise(F.try_divide(x.cast("double"), top))),
    )


def z_scores(array: Column) -> Column:
    """(x - mean) / population deviation; null without deviation."""
    n = F.size(array)
    mean = total(array) / n
    moments = F.struct(mean.alias("mean"), F.sqrt(F.greatest(dot(array, array) / n - mean * mean, F.lit(0.0))).alias("sd"))
    return _once(moments, lambda m: F.transform(array, lambda x: F.try_divide(x.cast("double") - m["mean"], m["sd"])))


def arg_max(array: Column) -> Column:
    """Place (from 0) of the greatest element, the first of equals."""
    return F.array_position(array, F.array_max(array)) - 1


def top_places(array: Column, k: int) -> Column:
    """Places of the k greatest elements, -1 where an element isn't above 0."""
    ranked = F.sort_array(F.transform(array, lambda x, i: F.struct(x.alias("value"), (-i).alias("minus_place"))), asc=False)
    return F.transform(F.slice(ranked, 1, k), lambda s: F.when(s["value"] > 0, -s["minus_place"]).otherwise(-1))


def k_max_in_order(array: Column, k: int) -> Column:
    """The k greatest elements in their old order."""
    ranked = F.sort_array(F.transform(array, lambda x, i: F.struct(x.alias("value"), (-i).alias("minus_place"))), asc=False)
    kept = F.array_sort(F.transform(F.slice(ranked, 1, k), lambda s: F.struct((-s["minus_place"]).alias("place"), s["value"].alias("value"))))
    return F.transform(kept, lambda s: s["value"])


def share_correct(labels: Column, probabilities: Column, at: float = 0.5) -> Column:
    """Share of tasks whose thresholded probability equals the label."""
    same = F.zip_with(labels, probabilities, lambda y, p: (y > 0) == (p >= at))
    return F.size(F.filter(same, lambda x: x)) / F.size(labels)


def normalised_to(scores: Column, logit: Column, tiny: float = 1e-7) -> Column:
    """Scores scaled so that their absolute sum is the logit; zeros where they vanish."""
    return _once(
        total(F.transform(scores, lambda x: F.abs(x))),
        lambda size: F.transform(scores, lambda x: F.when(size <= tiny, 0.0).otherwise(F.try_divide(x.cast("double") * logit, size))),
    )


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def two_tailed(x: Column, threshold: Column) -> Column:
    return (x > threshold) | (x < -threshold)


def log2_floor(x: Column) -> Column:
    """log2 of values above 1, otherwise 0."""
    return F.when(x > 1, F.log2(x)).otherwise(0.0)
