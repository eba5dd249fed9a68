"""Pages deep inside an order, without sorting what lies before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Pivots counted in one pass, and rows that are few enough to sort.
PIVOTS, SMALL = 64, 100_000


def _before(order: list[tuple[str, bool]], pivot: Row, equal: bool) -> Column:
    """Whether a row sorts before ``pivot`` (or, if ``equal``, beside it). Nulls sort first if ascending, else last."""
    result = F.lit(equal)
    for name, ascending in reversed(order):
        own, other = F.col(name), F.lit(pivot[name])
        if pivot[name] is None:
            less = F.lit(False) if ascending else own.isNotNull()
        elif ascending:
            less = own.isNull() | (own < other)
        else:
            less = own.isNotNull() & (own > other)
        result = less | (own.eqNullSafe(other) & result)
    return F.coalesce(result, F.lit(False))


def sorting(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.asc_nulls_first(n) if ascending else F.desc_nulls_last(n) for n, ascending in order]


def page(df: DataFrame, order: list[tuple[str, bool]], offset: int, count: int,
         pivots: int = PIVOTS, small: int = SMALL) -> DataFrame:
    """Rows ``offset`` .. ``offset + count - 1`` of ``df`` in ``order`` (column, ascending).

    Selection by pivots: a few rows, drawn by a hash, cut the order into ranges; one scan with
    partial sums counts all ranges, and the search goes on in the one that holds the page,
    until it is small enough to sort. Each round looks at a sixtieth of the rows of the one
    before, conditions reach the scan, and no row is shuffled. Rows alike in all of ``order``
    are interchangeable: of such, any may make up the page.
    """
    names = [n for n, _ in order]
    inside, skipped = F.lit(True), 0
    while True:
        rows = df.where(inside)
        drawn = rows.select(*names).orderBy(F.xxhash64(*names)).limit(pivots).distinct().orderBy(*sorting(order)).collect()
        counted = rows.agg(F.count(F.lit(1)), *[
            F.count(F.when(_before(order, p, equal), 1)) for p in drawn for equal in (False, True)]).first()
        total, ahead = counted[0], list(zip(counted[1::2], counted[2::2]))
        at = offset - skipped
        if total <= small:
            break
        for p, (less, upto) in zip(drawn, ahead):
            if less <= at and at + count <= upto:
                return rows.where(_before(order, p, True) & ~_before(order, p, False)).limit(count)
        low = max((k for k, (_, upto) in enumerate(ahead) if upto <= at), default=None)
        high = min((k for k, (less, _) in enumerate(ahead) if less >= at + count), default=None)
        if low is None and high is None:
            break
        if low is not None:
            inside, skipped = inside & ~_before(order, drawn[low], True), skipped + ahead[low][1]
        if high is not None:
            inside = inside & _before(order, drawn[high], False)
    return rows.orderBy(*sorting(order)).offset(max(at, 0)).limit(count)
