"""A table under inspection: a DataFrame with positional column names, plus what is known of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from colscope.functions.text import quoted
from colscope.options import Limits, ParsingMetadata


@dataclass(frozen=True)
class Table:
    """``df`` holds the columns ``fields`` (``c0``, ``c1``, ...) and the ordering columns ``order``.

    Shown names live in ``columns``: they may repeat, differ only by case or hold dots, which
    positional names are safe from.
    """

    df: DataFrame
    columns: tuple[str, ...]
    order: tuple[str, ...] = ()
    format: str = "TABLE"
    path: str | None = None
    size_bytes: int | None = None
    total_columns: int | None = None
    parsing: ParsingMetadata | None = None
    sheet: str | None = None
    sheets: tuple[str, ...] = ()
    limits: Limits | None = None
    """Limits of previews, where ``open_table`` was given some."""

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(f"c{i}" for i in range(len(self.columns)))

    @property
    def width(self) -> int:
        return self.total_columns if self.total_columns is not None else len(self.columns)

    @classmethod
    def from_dataframe(
        cls, df: DataFrame, max_columns: int | None = None, order: Sequence[str] = (), **known
    ) -> Table:
        """Take the columns of a DataFrame by position; the ones named in ``order`` sort rows."""
        names = [name for name in df.columns if name not in order]
        kept = names if max_columns is None else names[:max_columns]
        chosen = [f"{quoted(name)} AS c{i}" for i, name in enumerate(kept)]
        return cls(
            df.selectExpr(*chosen, *map(quoted, order)),
            tuple(kept), tuple(order), total_columns=len(names), **known,
        )

    def with_df(self, df: DataFrame) -> Table:
        return replace(self, df=df)

    def data(self) -> DataFrame:
        """The data columns by position, without ordering columns."""
        return self.df.selectExpr(*self.fields)

    def named(self) -> DataFrame:
        """The data columns under their shown names."""
        return self.df.selectExpr(
            *(f"{field} AS {quoted(name)}" for field, name in zip(self.fields, self.columns, strict=True))
        )
