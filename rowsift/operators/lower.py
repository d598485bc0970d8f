"""Lowering: each plan node becomes DataFrame operations on a frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import timeattr
from ..functions.values import NULL_LIKE, Dynamic, Missing, Typed, Value, number_of, predicate, text_number
from ..plans import nodes as N
from ..plans.normalize import needs_order
from .frame import FIELDS, HIDDEN, Frame

CAST_TYPES = {"number": "number", "num": "number", "float": "number", "int": "number", "integer": "number", "string": "string", "str": "string", "text": "string", "bool": "bool", "boolean": "bool", "null": "null", "none": "null", "auto": "auto"}


def lower(plan: N.Plan, frame: Frame, strict: bool = False) -> Frame:
    """The plan over a frame.  ``strict``: projections and rewrites see literal top-level names only, not nested paths."""
    if needs_order(plan):
        frame = frame.ordered()
    frame = frame.made_ready(list(dict.fromkeys(p for node in plan.nodes for p in _named(node))))
    nodes = list(plan.nodes)
    while nodes:
        node = nodes.pop(0)
        if isinstance(node, N.Skip) and nodes and isinstance(nodes[0], N.Limit):
            frame = _slice(frame, node.n, nodes.pop(0).n)
        else:
            frame = _LOWER[type(node)](node, frame, plan, strict)
    return frame


def _named(node) -> list[str]:
    """Paths whose values a node reads."""
    if isinstance(node, N.Filter):
        return _named(node.predicate)
    if isinstance(node, (N.And, N.Or)):
        return _named(node.left) + _named(node.right)
    if isinstance(node, N.Not):
        return _named(node.inner)
    if isinstance(node, N.CountBy):
        return list(node.paths)
    return [node.path] if isinstance(node, (N.KeywordTest, N.ExpressionTest, N.Exists, N.Sort, N.Dedup, N.CountByTime, N.CountUnique, N.TypeCount, N.Stat, N.TimeAttr)) else []


# ── Rows ──


def _filter(n: N.Filter, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    test = predicate(n.predicate, f.value, plan.case_sensitive)
    return f.with_df(f.df.where(test & (F.col("__once") >= 0) if f.doc and f.ready else test))


def _hidden(f: Frame) -> list[str]:
    return [c for c in f.df.columns if c in HIDDEN or c.startswith("__")]


def _project(n: N.Project, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    if f.dynamic:
        found = [F.struct(F.lit(p).alias("key"), (F.try_element_at(F.col(FIELDS), F.lit(p)) if strict else f.variant(p)).alias("value")) for p in n.paths]
        fields = F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull()))
        return f.with_df(f.df.withColumn(FIELDS, fields), doc=None)
    cols, missing = [], set()
    for p in n.paths:
        v = f.value(p)
        if isinstance(v, Missing) or (strict and p not in f.names):
            continue
        cols.append((v.c if isinstance(v, Typed) else v.v).alias(p))
        if not isinstance(v, Typed) or v.null_is_missing:
            missing.add(p)
    keep = list(dict.fromkeys([*_hidden(f)]))
    df = f.df.select(*cols, *keep) if cols or keep else f.df.select(F.struct().alias("__empty"))
    return f.with_df(df, missing=frozenset(missing))


def _omit(n: N.Omit, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    if f.dynamic:
        gone = list(n.paths)  # a field is a name of the record; a path into one takes nothing away
        return f.with_df(f.df.withColumn(FIELDS, F.map_filter(F.col(FIELDS), lambda k, v: ~k.isin(gone))), doc=None)
    df = f.df
    for p in n.paths:
        if p in f.names:
            df = df.drop(p)
        elif "." in p and not strict and not isinstance(f.value(p), Missing):
            head, rest = p.split(".", 1)
            df = df.withColumn(head, F.col(head).dropFields(rest))
    return f.with_df(df, missing=f.missing & set(df.columns))


def _put(f: Frame, name: str, c: Column, keep_old: bool) -> Frame:
    """Sets a typed top-level field; where c is null the field stays as it was, or goes."""
    if f.dynamic:
        rest = F.map_filter(F.col(FIELDS), lambda k, v: k != name)
        put = F.map_concat(rest, F.create_map(F.lit(name), c))
        return f.with_df(f.df.withColumn(FIELDS, F.when(c.isNull(), F.col(FIELDS) if keep_old else rest).otherwise(put)), doc=None)
    return f.with_df(f.df.withColumn(name, c), missing=f.missing | {name})


def _whole(x: Column) -> Column:
    """Variant of a double: an integer where it is one."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 9.2e18), x.cast("long").cast("variant")).otherwise(x.cast("variant"))


def _arith(e, f: Frame) -> Column:
    if isinstance(e, N.Number):
        return F.lit(e.value)
    if isinstance(e, N.FieldRef):
        return f.value(e.path).num
    if isinstance(e, N.Length):
        v = f.value(e.path)
        if isinstance(v, Dynamic):
            items = F.size(F.try_variant_get(v.v, "$", "array<variant>"))
            return F.when(v.kind == "string", F.char_length(v.string)).when(v.kind == "array", items).cast("double")
        if v.static == "string":
            return F.char_length(v.c).cast("double")
        return F.when(v.c.isNotNull(), F.size(v.c)).cast("double") if v.static == "array" else F.lit(None).cast("double")
    a, b = _arith(e.left, f), _arith(e.right, f)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[e.op]()


def _map(n: N.MapExpr, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    x = _arith(n.expr, f)
    x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    if f.dynamic:
        return _put(f, n.out, F.when(x.isNotNull(), _whole(x)), True)
    old = f.value(n.out)
    if old.static in ("long", "double"):
        x = F.coalesce(x, old.num)
    return _put(f, n.out, x, True)


def _text_fn(n: N.TextFn, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    if f.dynamic:
        v = Dynamic(F.try_element_at(F.col(FIELDS), F.lit(n.path)))
        new = _text_call(n, v.string)
        return _put(f, n.path, F.when(v.string.isNotNull(), F.to_variant_object(new) if n.fn == "split" else new.cast("variant")), True)
    types = dict(f.df.dtypes)
    if n.path not in f.names or types[n.path] != "string":
        if strict or "." not in n.path or f.value(n.path).static != "string":
            return f
        head, rest = n.path.split(".", 1)
        return f.with_df(f.df.withColumn(head, F.col(head).withField(rest, _text_call(n, f.value(n.path).c))))
    return f.with_df(f.df.withColumn(n.path, _text_call(n, F.col(f"`{n.path}`"))))


def _text_call(n: N.TextFn, c: Column) -> Column:
    if n.fn in ("to_lower", "to_upper"):
        return F.lower(c) if n.fn == "to_lower" else F.upper(c)
    if n.fn == "replace":
        old, new = n.args
        if old:
            return F.replace(c, F.lit(old), F.lit(new))
        return F.concat(F.lit(new), F.array_join(F.split(c, ""), new), F.when(F.length(c) > 0, new).otherwise(""))
    sep = n.args[0]
    if sep:
        return F.split(c, "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    return F.when(F.length(c) == 0, F.array(F.lit(""), F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.split(c, ""), F.array(F.lit(""))))


def _time_attr(n: N.TimeAttr, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    x = timeattr.attribute(n.fn, f.value(n.path).epoch)
    return _put(f, n.fn, x.cast("variant") if f.dynamic else x, True)


# ── Casts ──


def cast_problem(n: N.Cast, f: Frame) -> Column:
    """Whether a cast takes the field away."""
    v = f.value(n.path)
    kind = CAST_TYPES[n.type]
    text = v.string if isinstance(v, Dynamic) else v.c if v.static == "string" else F.lit(None).cast("string")
    if kind == "number":
        return F.coalesce(text.isNotNull() & ~F.trim(text).isin(*NULL_LIKE) & text_number(text).isNull(), F.lit(False))
    if kind == "bool":
        return F.coalesce(~F.lower(text).isin("true", "1", "yes", "on", "false", "0", "no", "off"), F.lit(False))
    return F.lit(False)


def _cast(n: N.Cast, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    kind = CAST_TYPES[n.type]
    if f.dynamic:
        return _cast_dynamic(n, kind, f)
    v = f.value(n.path)
    if n.path not in f.names or isinstance(v, Missing):
        return f
    text = v.c if v.static == "string" else None
    missing = f.missing
    if kind == "string":
        new = v.text
    elif kind == "null":
        new = F.lit(None).cast("string")
    elif kind == "bool":
        if text is not None:
            low = F.lower(text)
            new = F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off"), False)
            missing = missing | {n.path}
        else:
            new = v.c != 0 if v.static in ("long", "double") else v.c
    elif kind == "number":
        if text is not None:
            new = F.when(~F.trim(text).isin(*NULL_LIKE), text_number(text))
            missing = missing | {n.path}
        else:
            new = v.c.cast("long") if v.static == "bool" else v.c
    else:  # auto: values of several types need a variant
        new = v.c if text is None else auto_coerce(text)
    return f.with_df(f.df.withColumn(n.path, new), missing=missing)


def auto_coerce(text: Column, trimmed: bool = False) -> Column:
    """Variant that a text cell stands for: null-like, bool, integer, finite number, else the text."""
    t = F.trim(text)
    body = t if trimmed else text
    integer = F.when(body.rlike(r"^[+-]?\d+$"), body.try_cast("bigint"))
    double = text_number(body)
    finite = F.when(~F.isnan(double) & (F.abs(double) != float("inf")), double)
    null = F.parse_json(F.lit("null"))
    return F.when(text.isNull(), F.lit(None).cast("variant")).when(t.isin(*NULL_LIKE), null).when(F.lower(body) == "true", F.lit(True).cast("variant")).when(F.lower(body) == "false", F.lit(False).cast("variant")).when(integer.isNotNull(), integer.cast("variant")).when(finite.isNotNull(), finite.cast("variant")).otherwise(body.cast("variant"))


def _cast_dynamic(n: N.Cast, kind: str, f: Frame) -> Frame:
    v = Dynamic(F.try_element_at(F.col(FIELDS), F.lit(n.path)))
    null, string = F.parse_json(F.lit("null")), v.string
    if kind == "null":
        new = F.when(v.present, null)
    elif kind == "string":
        new = F.when(v.present, v.text.cast("variant"))
    elif kind == "auto":
        new = F.when(v.kind == "string", auto_coerce(string)).otherwise(v.v)
    elif kind == "bool":
        low = F.lower(string)
        new = F.when(v.kind == "number", (v.number != 0).cast("variant")).when(v.kind == "string", F.when(low.isin("true", "1", "yes", "on"), F.lit(True).cast("variant")).when(low.isin("false", "0", "no", "off"), F.lit(False).cast("variant"))).otherwise(v.v)
    else:
        number = text_number(string)
        finite = F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(0.0)).otherwise(number)
        integer = F.when(string.rlike(r"^[+-]?\d+$"), string.try_cast("bigint"))
        parsed = F.when(F.trim(string).isin(*NULL_LIKE), null).when(integer.isNotNull(), integer.cast("variant")).when(finite.isNotNull(), finite.cast("variant"))
        new = F.when(v.kind == "string", parsed).when(v.kind == "bool", F.try_variant_get(v.v, "$", "boolean").cast("long").cast("variant")).otherwise(v.v)
    return _put(f, n.path, new, False)


# ── Order ──


def sort_columns(v: Value, desc: bool) -> list[Column]:
    """Missing first, then numbers by value, then other values by text; reversed for desc, where ties keep their order."""
    if isinstance(v, Missing):
        return []
    if v.static in ("long", "double", "time", "bool") and not v.null_is_missing:
        if v.static in ("long", "double"):  # a null's text comes behind all numbers
            return [v.c.desc_nulls_first()] if desc else [v.c.asc_nulls_last()]
    absent = F.when(v.present, 1).otherwise(0)
    rank = F.when(v.num.isNotNull(), 0).otherwise(1)
    number = F.coalesce(v.num, F.lit(0.0))
    text = F.when(v.num.isNull(), v.text)
    cols = [absent, rank, number, text]
    if v.static in ("long", "double"):
        cols = [absent, v.c]
    elif v.static in ("time", "bool"):
        cols = [absent, F.when(v.null, 1).otherwise(0), v.c]
    return [c.desc() if desc else c.asc() for c in cols]


def _sort(n: N.Sort, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    f = f.ordered()
    keys = sort_columns(f.value(n.path), n.desc)
    if not keys:
        return f
    df, order = f.df, []
    tag = sum(c.startswith("__k") for c in df.columns)
    named = []
    for i, k in enumerate(keys):  # kept as columns: later stages may change the field
        name = f"__k{tag + i}"
        named.append(name)
        order.append(F.col(name).desc() if n.desc else F.col(name).asc())
    plain = _bare_keys(f.value(n.path), n.desc)
    df = df.withColumns(dict(zip(named, plain, strict=True)))
    order = [_directed(F.col(name), f.value(n.path), n.desc) for name in named]
    return f.with_df(df, order=(*order, *f.order))


def _bare_keys(v: Value, desc: bool) -> list[Column]:
    if v.static in ("long", "double") and not v.null_is_missing:
        return [v.c]
    absent = F.when(v.present, 1).otherwise(0)
    if v.static in ("long", "double"):
        return [absent, v.c]
    if v.static in ("time", "bool"):
        return [absent, v.c] if v.null_is_missing else [v.c]
    rank = F.when(v.num.isNotNull(), 0).otherwise(1)
    return [absent, rank, F.coalesce(v.num, F.lit(0.0)), F.when(v.num.isNull(), v.text)]


def _directed(c: Column, v: Value, desc: bool) -> Column:
    return c.desc_nulls_first() if desc else c.asc_nulls_last()


def _limit(n: N.Limit, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    f = f.ordered()
    return f.with_df(f.df.orderBy(*f.order).limit(n.n))


def _slice(f: Frame, skipped: int, n: int) -> Frame:
    """The n rows after those skipped: one sort that keeps so many rows a task, while an offset of its own takes all rows into one task."""
    f = f.ordered()
    return f.with_df(f.df.orderBy(*f.order).offset(skipped).limit(n))


#: Rows skipped that are broadcast.
SKIPPED = 100_000


def _skip(n: N.Skip, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    f = f.ordered()
    if not f.placed:
        return f.with_df(f.df.orderBy(*f.order).offset(n.n))
    gone = f.df.orderBy(*f.order).limit(n.n).select(F.col("_ord").alias("__gone"))
    return f.with_df(f.df.join(F.broadcast(gone) if n.n <= SKIPPED else gone, F.col("_ord") == F.col("__gone"), "left_anti"))


def _dedup(n: N.Dedup, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    f = f.ordered()
    v = f.value(n.path)
    key = v.c if v.static in ("long", "bool") and not v.null_is_missing else F.coalesce(v.text, F.lit(""))
    ranked = f.df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*f.order)))
    return f.with_df(ranked.where("__rank = 1").drop("__rank"))


# ── Aggregates ──


def _count_all(n: N.CountAll, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    return Frame(f.df.agg(F.count(F.lit(1)).alias("count")))


def _count_by(n: N.CountBy, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    f = f.ordered()
    keys, texts = [], []
    for i, p in enumerate(n.paths):
        v, name = f.value(p), f"__g{i}"
        native = isinstance(v, Typed) and v.static in ("long", "bool") and not v.null_is_missing
        plain = isinstance(v, Typed) and v.static == "string" and not v.null_is_missing
        keys.append((v.c if native else F.coalesce(v.c, F.lit("null")) if plain else F.coalesce(v.text, F.lit(""))).alias(name))
        text = F.coalesce(F.col(name).cast("string"), F.lit("null")) if native else F.col(name)
        texts.append((text, p))
    first = _ordinal(f)
    grouped = f.df.select(*keys, first.alias("__first")).groupBy(*(f"__g{i}" for i in range(len(keys))))
    df = grouped.agg(F.count(F.lit(1)).alias("count"), F.min("__first").alias("_ord"))
    shown = {p: t.alias(p) for t, p in texts if p != "count"}  # the count takes the place of a field of its name
    return Frame(df.select(*shown.values(), "count", "_ord"), order=(F.col("count").desc(), F.col("_ord").asc()))


def _ordinal(f: Frame) -> Column:
    """The order of the input as one number where it can be, so that its minimum is kept in a hash table."""
    kind = dict(f.df.dtypes)["_ord"]
    if not kind.startswith("struct<file:int,block:bigint,row:bigint"):
        return F.col("_ord")
    part = lambda c, scale: F.col(f"_ord.{c}").cast("decimal(38,0)") * F.lit(str(scale)).cast("decimal(38,0)")
    return (part("file", 10**28) + part("block", 10**11) + F.col("_ord.row").bitwiseAND((1 << 33) - 1)).cast("decimal(38,0)")


def _count_by_time(n: N.CountByTime, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    epoch = f.value(n.path).epoch
    secs = timeattr.seconds_of(n.bucket)
    if secs is None and n.bucket.strip().lower() not in timeattr.CALENDAR:
        raise QueryError(f"unknown bucket '{n.bucket}'")
    label = timeattr.bucket_label(epoch, n.bucket)
    df = f.df.select(epoch.alias("__e"), label.alias("bucket")).where("__e is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))
    return Frame(df, order=(F.col("bucket").asc() if n.asc else F.col("bucket").desc(),))


def _count_unique(n: N.CountUnique, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    v = f.value(n.path)
    key = F.coalesce(v.text, F.lit("")) if n.by_text else v.json
    if isinstance(v, Typed) and v.static == "long" and not v.null_is_missing:  # the same count on the native type
        nulls = F.max(F.when(v.null, 1).otherwise(0)) if v.static == "long" else F.lit(0)
        return Frame(f.df.agg((F.count_distinct(v.c) + F.coalesce(nulls, F.lit(0))).cast("long").alias("count_unique")))
    return Frame(f.df.agg(F.count_distinct(key).alias("count_unique")))


def _type_count(n: N.TypeCount, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    f = f.ordered()
    df = f.df.select(f.value(n.path).kind.alias("type"), _ordinal(f).alias("_ord")).groupBy("type").agg(F.count(F.lit(1)).alias("count"), F.min("_ord").alias("_ord"))
    return Frame(df, order=(F.col("count").desc(), F.col("_ord").asc()))


def _fields(n: N.Fields, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    if f.dynamic:
        df = f.df.select(F.explode(F.map_keys(FIELDS)).alias("field")).distinct()
    else:  # a column counts if a row has it; those whose nulls are values are had by every row
        flags = [F.max(f.value(c).present).alias(f"c{i}") for i, c in enumerate(f.names)]
        one = f.df.agg(*flags) if flags else f.df.limit(0)
        pairs = F.array(*(F.when(F.col(f"c{i}"), F.lit(c)) for i, c in enumerate(f.names)))
        df = one.select(F.explode(F.array_compact(pairs)).alias("field"))
    return Frame(df, order=(F.col("field").asc(),))


def _stat(n: N.Stat, f: Frame, plan: N.Plan, strict: bool) -> Frame:
    v = f.value(n.path)
    x = v.num
    if n.fn in ("min", "max"):
        x = F.when(~F.isnan(x), x)
    out = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[n.fn](x)
    out = F.round(out, 6)
    finite = F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)
    return Frame(f.df.agg((finite if n.empty_null else F.coalesce(finite, F.lit(0.0))).alias(n.fn)))


def bad_numbers(n: N.Stat, f: Frame) -> Column:
    """Strings that a statistic skips and that don't stand for null."""
    v = f.value(n.path)
    text = v.string if isinstance(v, Dynamic) else v.c if v.static == "string" else F.lit(None).cast("string")
    return F.coalesce(text.isNotNull() & v.num.isNull() & ~F.trim(text).isin(*NULL_LIKE), F.lit(False))


_LOWER = {
    N.Filter: _filter,
    N.Cast: _cast,
    N.Project: _project,
    N.Omit: _omit,
    N.MapExpr: _map,
    N.TextFn: _text_fn,
    N.TimeAttr: _time_attr,
    N.Sort: _sort,
    N.Limit: _limit,
    N.Skip: _skip,
    N.Dedup: _dedup,
    N.CountAll: _count_all,
    N.CountBy: _count_by,
    N.CountByTime: _count_by_time,
    N.CountUnique: _count_unique,
    N.TypeCount: _type_count,
    N.Fields: _fields,
    N.Stat: _stat,
}

__all__ = ["lower", "cast_problem", "bad_numbers", "auto_coerce", "number_of", "reduce", "T"]
