"""Stages on string Columns that can also be applied to every element of an array."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Stage:
    """``one`` maps a string Column. ``each`` maps an array of strings element by element; it is only given for
    stages that are UDFs, which cannot stand in an expression over elements."""

    def __init__(self, one: Callable[[Column], Column], each: Callable[[Column], Column] | None = None):
        self.one = one
        self.native = each is None
        self.each = each or (lambda a: F.transform(a, one))

    def __call__(self, c: Column) -> Column:
        return self.one(c)

    @classmethod
    def of(cls, fn) -> "Stage":
        return fn if isinstance(fn, Stage) else cls(fn)


def chain(stages) -> Stage:
    """String stages one after the other."""
    stages = [Stage.of(s) for s in stages]

    def one(c: Column) -> Column:
        for s in stages:
            c = s(c)
        return c

    def each(a: Column) -> Column:
        for s in stages:
            a = s.each(a)
        return a

    return Stage(one, None if all(s.native for s in stages) else each)


#: Bytes of a batch that a UDF works on at once; Spark's batches have up to 10,000 rows of any length.
SLICE = 2_000_000


def in_slices(run: Callable[[pa.Array], pa.Array], rows: pa.Array) -> pa.Array:
    """What ``run`` makes of the rows, a few at a time: what it holds besides its result does not grow with the batch."""
    todo, out = [rows], []
    while todo:
        part = todo.pop()
        if len(part) > 1 and part.nbytes > SLICE:
            half = len(part) // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            out.append(run(part))
    return out[0] if len(out) == 1 else pa.concat_arrays(out)
