"""Frames: a DataFrame with what the semantics need beside its columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Dynamic, Missing, Typed, Value

#: Hidden columns: input order, original text, file and line.
HIDDEN = ("_ord", "_raw", "_src_file", "_src_line")
FIELDS = "fields"


@dataclass(frozen=True)
class Frame:
    """``dynamic``: the rows' fields are a map from name to variant in the column ``fields``.

    ``missing``: typed columns whose nulls stand for an absent field.  ``order``: the current order of the rows, as sort columns;
    empty until it is asked for.  ``position``: where a row stands in its files, to be read right above the scan.
    ``doc``: column of a dynamic frame with the whole record as one variant, while ``fields`` is as it was read; paths are read from it.
    ``ready``: paths whose parts are columns already, by tag; they hold as long as ``doc`` does.  ``fixed``: ``_ord`` is a position.
    """

    df: DataFrame
    dynamic: bool = False
    missing: frozenset[str] = frozenset()
    order: tuple[Column, ...] = ()
    warnings: tuple = field(default=())
    position: Column | None = None
    doc: str | None = None
    ready: dict[str, int] = field(default_factory=dict)
    fixed: bool = False

    @property
    def placed(self) -> bool:
        """Whether ``_ord`` is where a row stands in its files, and so the same whenever it is worked out."""
        return self.fixed or dict(self.df.dtypes).get("_ord", "").startswith("struct<file:int,block:bigint,row:bigint")

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c not in HIDDEN and not c.startswith("__")]

    def with_df(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **changes)

    def ordered(self) -> Frame:
        """The same frame with a column ``_ord`` for the order of the input."""
        if self.order:
            return self
        df = self.df if "_ord" in self.df.columns else self.df.withColumn("_ord", F.monotonically_increasing_id() if self.position is None else self.position)
        return replace(self, df=df, order=(F.col("_ord").asc(),), position=None, fixed=self.fixed or self.position is not None)

    def made_ready(self, paths: list[str]) -> Frame:
        """The frame with the parts of the values at these paths as columns, each worked out once a row.

        The random column keeps filters above from being moved below, where they would work the parts out again.
        """
        paths = [p for p in paths if p not in self.ready]
        if not self.doc or not paths:
            return self
        df, new = self.df, {p: i for i, p in enumerate(paths, len(self.ready))}
        for cols in Dynamic.steps({i: self.variant(p) for p, i in new.items()}):
            df = df.select("*", *(c.alias(name) for name, c in cols.items()))
        return replace(self, df=df.withColumn("__once", F.rand(0)), ready=self.ready | new)

    def variant(self, path: str) -> Column:
        head, *rest = path.split(".")
        if self.doc and "'" not in path:
            whole = F.col(self.doc)
            v = F.try_variant_get(whole, "$" + "".join(f"['{p}']" for p in (head, *rest)), "variant")
            if head != "value":
                return v
            inner = F.try_variant_get(whole, "$" + "".join(f"['{p}']" for p in rest), "variant") if rest else whole
            return F.when(F.schema_of_variant(whole).startswith("OBJECT"), v).otherwise(inner)  # a value that is no object
        v = F.try_element_at(F.col(FIELDS), F.lit(head))
        return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in rest), "variant") if rest else v

    def value(self, path: str) -> Value:
        """The value at a path; a path beyond the known columns is missing everywhere."""
        if self.dynamic:
            return Dynamic(None, self.ready[path]) if self.doc and path in self.ready else Dynamic(self.variant(path))
        head, *rest = path.split(".")
        types = {f.name: f.dataType for f in self.df.schema.fields}
        if path in types and path in self.names and "." in path:  # the output of a grouping by a nested path
            return Typed(F.col(f"`{path}`"), types[path], path in self.missing)
        if head not in self.names:
            return Missing()
        c, kind, absent = F.col(f"`{head}`"), types[head], head in self.missing
        for part in rest:
            if isinstance(kind, T.StructType) and part in kind.names:
                c, kind = c[part], kind[part].dataType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                c, kind = F.try_element_at(c, F.lit(part)), kind.valueType
            elif isinstance(kind, T.VariantType):
                c = F.try_variant_get(c, f"$['{part}']", "variant")
            else:
                return Missing()
            absent = True
        return Dynamic(c) if isinstance(kind, T.VariantType) else Typed(c, kind, absent)
