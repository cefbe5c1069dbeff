"""Solutions as DataFrames: one column per variable, with its kind and whether it is surely bound."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import values as V
from .functions.values import Kind, Val


@dataclass
class Rel:
    """``key``: a variable that no two solutions have in common, if one is known; derived solutions name none."""

    df: DataFrame
    kinds: dict[str, Kind] = field(default_factory=dict)
    certain: frozenset[str] = frozenset()
    key: str | None = None

    @property
    def vars(self) -> list[str]:
        return list(self.kinds)

    def val(self, v: str) -> Val:
        return Val(self.kinds[v], F.col(f"`{v}`"))

    def scope(self) -> dict[str, Val]:
        return {v: self.val(v) for v in self.kinds}

    def select(self, cols: dict[str, tuple[Kind, Column]], certain: frozenset[str] | None = None) -> Rel:
        df = self.df.select(*[c.alias(v) for v, (_, c) in cols.items()]) if cols else self.df.select(F.lit(1).alias("_row"))
        return Rel(df, {v: k for v, (k, _) in cols.items()}, self.certain & set(cols) if certain is None else certain)

    def only(self, wanted: list[str]) -> Rel:
        """Project; a variable that is never bound becomes a column of NULLs."""
        return self.select({v: (self.kinds[v], F.col(f"`{v}`")) if v in self.kinds else (V.TERM, F.lit(None).cast("string")) for v in wanted})

    def converted(self, kinds: dict[str, Kind]) -> Rel:
        """The same solutions with some columns in other kinds (in practice as generic terms)."""
        if all(self.kinds[v] == k for v, k in kinds.items() if v in self.kinds):
            return self
        cols = {v: (kinds.get(v, k), V.as_kind(self.val(v), kinds.get(v, k))) for v, k in self.kinds.items()}
        return self.select(cols)

    def renamed(self, names: dict[str, str]) -> Rel:
        return self.select({names.get(v, v): (k, F.col(f"`{v}`")) for v, k in self.kinds.items()}, frozenset(names.get(v, v) for v in self.certain))

    def where(self, c: Column) -> Rel:
        return Rel(self.df.where(c), self.kinds, self.certain)


def unify(a: Rel, b: Rel) -> tuple[Rel, Rel]:
    """Bring the variables that both have to one kind each."""
    kinds = {v: V.common(a.kinds[v], b.kinds[v]) for v in a.kinds if v in b.kinds}
    return a.converted(kinds), b.converted(kinds)


def never_equal(a: Kind, b: Kind) -> bool:
    """Terms of these kinds can't be the same term."""
    if a == b or "term" in (a.tag, b.tag):
        return False
    if a.tag == b.tag == "iri":
        return not (a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix))
    return True
