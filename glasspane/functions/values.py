"""Names for intermediate values inside one column expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bound(reader: Callable[..., Column]) -> Callable[..., Column]:
    """A reader whose first argument is worked out once and then named.

    Readers use their file at every step of a fold. Where the file is itself an
    expression, it would otherwise be copied to each of these places when
    projections are merged, which is slow, and lets equal parts of a file before
    and after a change be taken for one another.
    """

    @wraps(reader)
    def of(data: Column, *args, **named) -> Column:
        return let(data, lambda d: reader(d, *args, **named))

    return of
