"""Exact interpolated quantiles that never gather a large column in one task."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A bracket with this many values or fewer is listed instead of narrowed further.
LISTED_VALUES = 25_000
SKETCH_ACCURACY = 10_000


@dataclass(frozen=True)
class _Span:
    """An open interval of values known to hold a wanted rank."""

    column: str
    below: int  # values of the column under the interval
    size: int  # values inside
    low: float | None = None
    high: float | None = None

    def values(self) -> Column:
        inside = F.col(self.column).isNotNull()
        if self.low is not None:
            inside &= F.col(self.column) > F.lit(self.low)
        if self.high is not None:
            inside &= F.col(self.column) < F.lit(self.high)
        return F.when(inside, F.col(self.column))


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    listed: int = LISTED_VALUES,
    sizes: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of several columns, NULLs ignored.

    A quantile sketch proposes a bracket around each wanted rank, an exact count says on
    which side or inside it the rank lies, and the search goes on there until the bracket
    holds ``listed`` values or fewer. Each round is two
    aggregations with partial aggregation and shrinks the bracket several thousand
    times; ``df`` should therefore be a staged table. Only counts and bracket ends
    come to the driver, and the result is exact whatever the sketch's error. ``sizes``, how many values
    each column has, saves the first pass where they are known.
    """
    df = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    sizes = sizes or df.agg(*(F.count(c).alias(c) for c in columns)).first().asDict()
    ranks = {
        (c, rank)
        for c in columns
        if sizes[c]
        for p in probs
        for rank in (floor(p * (sizes[c] - 1)), ceil(p * (sizes[c] - 1)))
    }
    found = values_at(df, sizes, ranks, listed)
    return {c: [interpolated(found, c, sizes[c], p) for p in probs] for c in columns}


def interpolated(found: dict, column: str, size: int, prob: float) -> float | None:
    """The quantile of a column from the values at the two ranks around it."""
    if not size:
        return None
    position = prob * (size - 1)
    lower, upper = floor(position), ceil(position)
    at_lower, at_upper = found[column, lower], found[column, upper]
    if lower == upper or at_lower == at_upper:
        return at_lower
    return (upper - position) * at_lower + (position - lower) * at_upper


def values_at(df: DataFrame, sizes: dict, ranks: set, listed: int = LISTED_VALUES) -> dict:
    """The value at each (column, rank) of columns with ``sizes`` values."""
    found: dict[tuple[str, int], float] = {}
    search = {(c, rank): _Span(c, 0, sizes[c]) for c, rank in sorted(ranks)}
    while search:
        small = {key: span for key, span in search.items() if span.size <= max(listed, 1)}
        large = {key: span for key, span in search.items() if key not in small}
        found |= _read_small(df, small)
        search = {}
        if large:
            hits, search = _narrow(df, large)
            found |= hits
    return found


def _read_small(df: DataFrame, small: dict) -> dict:
    if not small:
        return {}
    spans = sorted(set(small.values()), key=lambda s: (s.column, s.below))
    lists = {span: F.sort_array(F.collect_list(span.values())) for span in spans}
    picks = [
        F.element_at(lists[span], rank - span.below + 1).alias(f"v{i}")
        for i, ((_, rank), span) in enumerate(small.items())
    ]
    row = df.agg(*picks).first()
    return {key: row[i] for i, key in enumerate(small)}


def _narrow(df: DataFrame, large: dict) -> tuple[dict, dict]:
    """One round for all open ranks: a sketch per span, then exact counts at its cuts."""
    slack = 2 / SKETCH_ACCURACY
    shares: dict[_Span, set[float]] = {}
    for (_, rank), span in large.items():
        at = (rank - span.below) / max(span.size - 1, 1)
        shares.setdefault(span, set()).update((max(at - slack, 0.0), min(at + slack, 1.0)))
    sketches = [
        F.percentile_approx(span.values(), F.array(*(F.lit(p) for p in sorted(wanted))), SKETCH_ACCURACY)
        for span, wanted in shares.items()
    ]
    row = df.agg(*(sketch.alias(f"s{i}") for i, sketch in enumerate(sketches))).first()
    cuts = {span: sorted(set(row[i])) for i, span in enumerate(shares)}

    pairs = [(span, cut) for span in cuts for cut in cuts[span]]
    counts = [
        F.struct(F.count_if(span.values() < cut), F.count_if(span.values() <= cut)).alias(f"c{i}")
        for i, (span, cut) in enumerate(pairs)
    ]
    counted = dict(zip(pairs, df.agg(*counts).first(), strict=True))

    found, search = {}, {}
    for key, span in large.items():
        place, low, passed = key[1] - span.below, span.low, 0
        for cut in cuts[span]:
            under, upto = counted[span, cut]
            if place < under:
                search[key] = _Span(span.column, span.below + passed, under - passed, low, cut)
                break
            if place < upto:
                found[key] = cut
                break
            low, passed = cut, upto
        else:
            search[key] = _Span(span.column, span.below + passed, span.size - passed, low, span.high)
    return found, search
