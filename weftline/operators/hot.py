"""Joins to per-key values that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows of a join is hot; there are at most 1 / HOT_SHARE such keys, which bounds their broadcast.
HOT_SHARE = 1 / 1000
#: Fewer rows than this on one key fit one task whatever their share.
HOT_ROWS = 1_000_000


def hot_join(left: DataFrame, right: DataFrame, key: list[str], weight: str, total: int, how: str = "inner", floor: int = HOT_ROWS, share: float = HOT_SHARE) -> DataFrame:
    """left joined to right, whose rows are unique by key; `weight` of right is the number of left rows with that key, of `total` in all.

    Keys with at least max(floor, share * total) rows are joined by broadcasting their right rows, at most 1 / share of them, so that no task gets a hot key's rows;
    all others are shuffled. Both inputs should be cheap to read twice. `weight` isn't returned.
    """
    least = max(floor, int(share * total))
    if total < least:
        return left.join(right.drop(weight), key, how)
    hot = right.filter(F.col(weight) >= least)
    keys = hot.select(*key)
    return left.join(F.broadcast(hot.drop(weight)), key, "inner").unionByName(
        left.join(F.broadcast(keys), key, "left_anti").join(right.filter(F.col(weight) < least).drop(weight), key, how), allowMissingColumns=False
    )
