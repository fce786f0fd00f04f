"""Model matrices: products of numbers and cells of interacting categories as one vector."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.operators.summary import Summary, as_number


@dataclass(frozen=True)
class Term:
    """A set of columns; none of them is the intercept."""

    names: tuple[str, ...]

    @classmethod
    def of(cls, *names: str) -> Term:
        if not names:
            raise ValueError("a term has at least one column")
        return cls(tuple(sorted(set(names))))

    def __lt__(self, other: Term) -> bool:
        return (len(self.names), self.names) < (len(other.names), other.names)

    def __str__(self) -> str:
        return ":".join(self.names) or "1"


INTERCEPT = Term(())


def model_matrix(df: DataFrame, terms: list[Term], summary: Summary) -> Column:
    """The row's vector. A term of numbers is one slot with their product; with categories it has
    a slot for each combination of levels, holding the product of its numbers (1 if none), less the
    first combination if there is an intercept. An unknown or null level or a missing number gives
    a null vector element, so that the row can be found.
    """
    cells: list[Column] = []
    for t in terms:
        numbers = [n for n in t.names if summary[n].numeric]
        words = [n for n in t.names if not summary[n].numeric]
        value = reduce(lambda a, b: a * b, [as_number(df, n) for n in numbers], F.lit(1.0))
        if not words:
            cells.append(value)
            continue
        combos = list(product(*[summary[n].levels for n in words]))
        known = reduce(lambda a, b: a & b, [F.coalesce(df[n].isin(summary[n].levels), F.lit(False)) for n in words])
        for combo in combos[1:] if INTERCEPT in terms else combos:
            here = reduce(lambda a, b: a & b, [df[n] == v for n, v in zip(words, combo)])
            cells.append(F.when(known & here, value).when(known, 0.0))
    return F.array(*cells)
