"""Row samples for the trees of a forest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A sample with replacement is one without from this many copies of every row.
COPIES = 16
# Draws are affine maps of a row's hash modulo this prime, in whole numbers below 2^63.
PRIME = 2**31 - 1
# Trees draw from so many times their sample, or all rows of a smaller table.
POOL = 64
# Fixed multipliers that spread the draws' coefficients.
_SPREAD = (1_103_515_245, 1_299_709_033, 1_618_033_989, 1_732_050_807)


def row_marks() -> tuple[Column, Column]:
    """Two numbers below 2^28 from the MD5 of a row's user and date."""
    digest = F.md5(F.concat_ws("|", F.col("user").cast("string"), F.col("date").cast("string")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 7), 16, 10).cast("bigint") for at in (1, 8))


def coefficients(draw: int, seed: int) -> tuple[int, int, int, int]:
    """Multipliers and shifts of a draw, for the two halves of its numbers."""
    return tuple(1 + ((draw + 1) * k + (seed % PRIME) * (i + 7)) % (PRIME - 1) for i, k in enumerate(_SPREAD))


def _share(wanted: int, rows: int) -> float:
    """Sampling rate whose yield falls short of ``wanted`` only beyond eight deviations."""
    return (wanted + 8 * wanted**0.5 + 64) / max(rows, 1)


def tree_samples(
    features: DataFrame, rows: int, trees: int, size: int, seed: int, bootstrap: bool = False
) -> DataFrame:
    """``size`` rows for each tree, drawn on its own: the input plus ``tree_id, pick``.

    All trees draw from one pool, a uniform sample of ``POOL * size`` rows by hash, so that a row of a large
    table costs one hash and not a test per tree. Every row of the pool draws a number for every tree by its
    hash, hence the sample does not depend on the partitioning; only the hits, a little more than ``trees * size`` in
    all, are shuffled and ranked within their tree. ``bootstrap`` draws with replacement.
    """
    copies = COPIES if bootstrap else 1
    pool = min(rows, POOL * size)
    limit = int(min(1.0, _share(size, pool * copies)) * PRIME)
    marked = features.withColumns(dict(zip(("_first", "_second"), row_marks(), strict=True)))
    mark = F.col("_first") * F.lit(2**28) + F.col("_second")
    marked = marked.where(mark < F.lit(min(1.0, _share(POOL * size, rows)) * 2.0**56))
    # A comparison per draw, compiled one after the other, and then the second half for hits alone.
    by_draw = [coefficients(draw, seed) for draw in range(trees * copies)]
    tests = ", ".join(f"if(({a} * _first + {b}) % {PRIME} < {limit}, {draw}, NULL)" for draw, (a, b, *_) in enumerate(by_draw))
    drawn = marked.withColumn("_draw", F.explode(F.expr(f"array_compact(array({tests}))")))
    upper, lower = (
        f"(element_at(array({', '.join(f'{c[i]}L' for c in by_draw)}), _draw + 1) * {mark} "
        f"+ element_at(array({', '.join(f'{c[i + 1]}L' for c in by_draw)}), _draw + 1)) % {PRIME}"
        for i, mark in ((0, "_first"), (2, "_second"))
    )
    drawn = drawn.withColumns({"pick": F.expr(f"({upper}) * {PRIME}L + {lower}"), "tree_id": F.expr(f"_draw % {trees}")})
    order = F.row_number().over(W.partitionBy("tree_id").orderBy("pick", "user", "date"))
    return drawn.withColumn("place", order).where(F.col("place") <= size).drop("place", "_draw", "_first", "_second")
