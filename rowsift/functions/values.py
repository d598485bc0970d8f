"""How a field's value is read: string form, number, JSON form, kind, time.

A field of a typed frame is resolved when the plan is made, so that comparisons become native and reach the scan; a field
of a dynamic frame is a variant and resolved row by row.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.nodes import And, Exists, ExpressionTest, KeywordTest, Not, Or
from .regexes import glob, translate
from .timeattr import relative

NUMERIC = r"^(?i)[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"
TIMESTAMP = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d((\.\d+)?(Z|[+-]\d\d:?\d\d)|Z)?$"
NULL_LIKE = ("", "None", "none", "null", "NULL", "NA", "N/A", "n/a", "NaN", "nan")


def never() -> Column:
    return F.lit(False)


def number_of(text: str) -> float | None:
    return float(text.replace("_", "x") if "_" in text else text) if re.match(NUMERIC.replace("(?i)", ""), text, re.I) else None


def text_number(c: Column) -> Column:
    """Number that a text spells, else null."""
    return F.when(c.rlike(NUMERIC), c.try_cast("double"))


def number_text(c: Column) -> Column:
    """Shortest decimal form of a double: plain up to 1e16 and from 1e-5 on, else with an exponent."""
    s = c.cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(F.substring_index(s, "E", 1), "^-", "")
    e = F.substring_index(s, "E", -1).try_cast("int")
    whole, part = F.substring_index(body, ".", 1), F.regexp_replace(F.substring_index(body, ".", -1), "^0$", "")
    digits = F.concat(whole, part)
    big = F.when(F.length(part) <= e, F.concat(F.rpad(digits, e + 1, "0"), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.length(digits))))
    little = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    expo = F.concat(whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)), F.lit("e"), e.cast("string"))
    scaled = F.when((e >= 7) & (e < 16), big).when((e < 0) & (e >= -5), little).otherwise(expo)
    return F.when(~s.contains("E"), s).otherwise(F.concat(sign, scaled))


def literal_text(x: float) -> str:
    """The text of a double by the same rule."""
    if math.isnan(x) or math.isinf(x):
        return "null"
    m, e = f"{x:e}", 0
    r = repr(x)
    if "e" not in r and "E" not in r:
        return r
    m, e = r.split("e")
    return format(x, "f") if 0 <= int(e) < 16 else f"{m}e{int(e)}"


def text_epoch(c: Column) -> Column:
    return F.when(c.rlike(TIMESTAMP), F.unix_seconds(F.regexp_replace(c, r"([+-]\d\d)(\d\d)$", "$1:$2").try_cast("timestamp")))


def number_epoch(c: Column) -> Column:
    return F.when(c >= 1e12, (c / 1000).cast("long")).when(c >= 1e9, c.cast("long"))


class Value:
    """Columns of one field: present, null, text (null where missing), scalar, num, epoch, kind, json."""

    present: Column
    null: Column
    text: Column
    scalar: Column
    num: Column
    epoch: Column
    kind: Column
    json: Column
    static = "dynamic"

    def has_element(self, needle: str, case_sensitive: bool) -> Column:
        raise NotImplementedError


class Missing(Value):
    """A field that no row has."""

    static = "missing"

    def __init__(self):
        self.present = self.null = self.scalar = F.lit(False)
        self.text = self.json = F.lit(None).cast("string")
        self.num, self.epoch, self.kind = F.lit(None).cast("double"), F.lit(None).cast("long"), F.lit("missing")


class Typed(Value):
    """A column of known type.  ``null_is_missing``: its nulls stand for rows that lack the field."""

    def __init__(self, c: Column, kind: T.DataType, null_is_missing: bool = False):
        self.c, self.type, self.null_is_missing = c, kind, null_is_missing
        self.present = c.isNotNull() if null_is_missing else F.lit(True)
        self.null = F.lit(False) if null_is_missing else c.isNull()
        no_text, no_num, no_epoch = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("long")
        self.scalar, self.num, self.epoch = F.lit(True), no_num, no_epoch
        if isinstance(kind, T.StringType):
            self.static, own, label, text = "string", "string", c, c
            self.num, self.epoch, self.json = text_number(c), text_epoch(c), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
            label = "string"
        elif isinstance(kind, T.BooleanType):
            self.static, label, text = "bool", "bool", c.cast("string")
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            d = c.cast("double")
            self.static, label, text = "double", "number", number_text(d)
            self.num, self.epoch = d, number_epoch(d)
        elif isinstance(kind, T.IntegralType):
            self.static, label, text = "long", "number", c.cast("string")
            self.num, self.epoch = c.cast("double"), number_epoch(c.cast("double"))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            ts = c.cast("timestamp")
            self.static, label = "time", "string"
            text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(ts, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z"))
            self.epoch = F.unix_seconds(ts)
        elif isinstance(kind, T.NullType):
            self.static, label, text = "null", "null", no_text
        else:
            self.static, label, text = ("array" if isinstance(kind, T.ArrayType) else "object"), ("array" if isinstance(kind, T.ArrayType) else "object"), F.to_json(c)
            self.scalar = c.isNull()
        empty = no_text if null_is_missing else F.lit("null")
        self.text = F.when(c.isNull(), empty).otherwise(text)
        self.kind = F.when(c.isNull(), "missing" if null_is_missing else "null").otherwise(label)
        if self.static != "string":
            self.json = F.when(c.isNull(), empty).otherwise(F.concat(F.lit('"'), text, F.lit('"')) if self.static == "time" else text)
        else:
            self.json = F.when(c.isNull(), empty).otherwise(self.json)

    def has_element(self, needle: str, case_sensitive: bool) -> Column:
        if self.static != "array":
            return never()
        item = self.type.elementType
        return F.coalesce(F.exists(self.c, lambda x: _same(Typed(x, item).text, needle, case_sensitive)), F.lit(False))


class Dynamic(Value):
    """A variant; SQL null is a missing field, variant null a null one.  ``tag``: its parts are columns already (see steps)."""

    PARTS = ("v", "schema", "kind", "string", "number", "text", "num", "epoch")

    def __init__(self, v: Column | None, tag: int | None = None):
        if tag is not None:
            self.v, _, self.kind, self.string, self.number, self.text, self.num, self.epoch = (F.col(f"__{p}{tag}") for p in self.PARTS)
            self.present, self.null = self.v.isNotNull(), self.kind == "null"
            self.scalar = ~self.kind.isin("array", "object", "missing")
            self.json = F.when(self.present, F.to_json(self.v))
            return
        self.v = v
        self.present = v.isNotNull()
        self.null = F.coalesce(F.is_variant_null(v), F.lit(False))
        schema = F.schema_of_variant(v)
        self.kind = F.when(v.isNull(), "missing").when(self.null, "null").when(schema == "STRING", "string").when(schema == "BOOLEAN", "bool").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").otherwise("number")
        string = F.try_variant_get(v, "$", "string")
        self.string = F.when(self.kind == "string", string)
        double = F.try_variant_get(v, "$", "double")
        self.number = F.when(self.kind == "number", double)
        whole = F.try_variant_get(v, "$", "bigint")
        exact = F.when((schema == "BIGINT") | (schema.startswith("DECIMAL") & (whole.cast("double") == double)), whole.cast("string"))
        num_text = F.coalesce(exact, number_text(double))
        self.text = F.when(v.isNull(), F.lit(None).cast("string")).when(self.null, "null").when(self.kind == "string", string).when(self.kind == "number", num_text).when(self.kind == "bool", F.try_variant_get(v, "$", "boolean").cast("string")).otherwise(F.to_json(v))
        self.scalar = ~self.kind.isin("array", "object", "missing")
        self.num = F.coalesce(self.number, text_number(self.string))
        self.epoch = F.coalesce(text_epoch(self.string), number_epoch(self.number))
        self.json = F.when(v.isNotNull(), F.to_json(v))

    @classmethod
    def steps(cls, of: dict[int, Column]) -> list[dict[str, Column]]:
        """Columns to be added one step after another, each using those before, so that every part is worked out once a row."""
        out: list[dict[str, Column]] = [{} for _ in range(5)]
        for tag, variant in of.items():
            v, schema, kind, string, number, *_ = (F.col(f"__{p}{tag}") for p in cls.PARTS)
            whole = F.col(f"__whole{tag}")
            out[0][f"__v{tag}"] = variant
            out[1][f"__schema{tag}"] = F.schema_of_variant(v)
            out[2][f"__kind{tag}"] = F.when(v.isNull(), "missing").when(schema == "VOID", "null").when(schema == "STRING", "string").when(schema == "BOOLEAN", "bool").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").otherwise("number")
            out[3][f"__string{tag}"] = F.when(kind == "string", F.try_variant_get(v, "$", "string"))
            out[3][f"__number{tag}"] = F.when(kind == "number", F.try_variant_get(v, "$", "double"))
            out[3][f"__whole{tag}"] = F.when((schema == "BIGINT") | schema.startswith("DECIMAL"), F.try_variant_get(v, "$", "bigint"))
            exact = F.when((schema == "BIGINT") | (whole.cast("double") == number), whole.cast("string"))
            shown = F.when(kind == "number", F.coalesce(exact, number_text(number))).when(kind == "string", string).when(kind == "null", "null").when(kind == "bool", F.try_variant_get(v, "$", "boolean").cast("string"))
            out[4][f"__text{tag}"] = F.when(kind != "missing", F.coalesce(shown, F.to_json(v)))
            out[4][f"__num{tag}"] = F.coalesce(number, text_number(string))
            out[4][f"__epoch{tag}"] = F.coalesce(text_epoch(string), number_epoch(number))
        return out

    def has_element(self, needle: str, case_sensitive: bool) -> Column:
        items = F.try_variant_get(self.v, "$", "array<variant>")
        return F.coalesce(F.exists(items, lambda x: _same(Dynamic(x).text, needle, case_sensitive)), F.lit(False))


def _same(text: Column, literal: str, case_sensitive: bool) -> Column:
    return text == literal if case_sensitive else F.lower(text) == literal.lower()


def predicate(p, value_of, case_sensitive: bool) -> Column:
    """Condition of a predicate; ``value_of`` gives the Value of a path.

    Where nothing is compared it is null, which a filter and ``and`` and ``or`` take as false, so a bare comparison stays bare and
    reaches the scan; only ``not`` has to tell null from true.
    """
    if isinstance(p, And):
        return predicate(p.left, value_of, case_sensitive) & predicate(p.right, value_of, case_sensitive)
    if isinstance(p, Or):
        return predicate(p.left, value_of, case_sensitive) | predicate(p.right, value_of, case_sensitive)
    if isinstance(p, Not):
        return ~F.coalesce(predicate(p.inner, value_of, case_sensitive), F.lit(False))
    v = value_of(p.path)
    if isinstance(p, Exists):
        return v.present
    test = _keyword if isinstance(p, KeywordTest) else _expression
    return test(v, p, case_sensitive)


def _two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


_CANONICAL = re.compile(r"0|-?[1-9]\d{0,18}")


def _keyword_equal(v: Value, literal: str, cs: bool) -> Column:
    folded = literal if cs else literal.lower()
    if v.static in ("long", "double", "bool"):  # folded to a native comparison, which reaches the scan
        null = v.null if folded == "null" else never()
        if v.static == "long" and _CANONICAL.fullmatch(folded) and -(2**63) <= int(folded) < 2**63:
            return v.c == F.lit(int(folded))
        if v.static == "bool" and folded in ("true", "false"):
            return v.c == F.lit(folded == "true")
        if v.static == "double":
            x = number_of(folded)
            if x is not None and literal_text(x).lower() == folded.lower():
                return v.c == F.lit(x)
        return null
    if v.static == "string":
        test = _same(v.c, literal, cs)
        return (test | v.null) if folded == "null" else test
    return v.scalar & _same(v.text, literal, cs)


def _compare(a, op: str, b) -> Column:
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def _range(v: Value, op: str, literal: str, now: int) -> Column:
    at, x = relative(literal, now), number_of(literal)
    if v.static == "missing":
        return never()
    if v.static in ("long", "double"):
        test = never()
        if x is not None and not math.isnan(x):
            test = _compare(v.c, op, F.lit(int(x) if v.static == "long" and x == int(x) and abs(x) < 2**53 else x)) if not math.isinf(x) else _compare(v.num, op, F.lit(x))
            if v.static == "double":
                test = test & ~F.isnan(v.num)
        test = _two_valued(test) | _two_valued(v.null & _compare(F.lit("null"), op, F.lit(literal))) if not v.null_is_missing else test
        return F.when(v.epoch.isNotNull(), _compare(v.epoch, op, F.lit(at))).otherwise(test) if at is not None else test
    if v.static == "time":
        when = parse_time(literal) if at is None else datetime.fromtimestamp(at, timezone.utc).replace(tzinfo=None)
        if when is not None:
            edge = F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz") if isinstance(v.type, T.TimestampNTZType) else F.lit(when.isoformat(sep=" ") + "Z").cast("timestamp")
            return _compare(v.c, op, edge)
        return _compare(v.text, op, F.lit(literal))
    text = _compare(v.text, op, F.lit(literal))
    number = never() if x is None else _compare(v.num, op, F.lit(x)) & ~F.isnan(v.num)
    test = F.when(v.num.isNotNull(), number).otherwise(text)
    return F.when(v.epoch.isNotNull(), _compare(v.epoch, op, F.lit(at))).otherwise(test) if at is not None else test


def parse_time(text: str) -> datetime | None:
    if not re.match(TIMESTAMP, text):
        return None
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def _keyword(v: Value, p: KeywordTest, cs: bool) -> Column:
    op, literal, now = p.op, p.value, getattr(p, "now", 0)
    if op == "=":
        return _keyword_equal(v, literal, cs)
    if op == "!=":
        if v.static in ("array", "object", "dynamic"):
            return F.coalesce(~_same(v.text, literal, cs), F.lit(True))
        return ~_two_valued(_keyword_equal(v, literal, cs))
    if op == "between":
        return _two_valued(_range(v, ">=", literal, now)) & _two_valued(_range(v, "<=", p.high, now))
    if op in (">", "<", ">=", "<="):
        return _range(v, op, literal, now)
    if op in ("~=", "glob"):
        return v.text.rlike(translate(literal) if op == "~=" else glob(literal))
    text, needle = (v.text, literal) if cs else (F.lower(v.text), literal.lower())
    return {"contains": text.contains, "startswith": text.startswith, "endswith": text.endswith}[op](needle)


def _expression(v: Value, p: ExpressionTest, cs: bool) -> Column:
    op, x = p.op, p.value
    if op in ("==", "!="):
        same = _two_valued(_expression_equal(v, x, cs))
        return same if op == "==" else ~same
    if op in (">", "<", ">=", "<="):
        y = number_of(x) if isinstance(x, str) else x if isinstance(x, float) else None
        if y is None or math.isnan(y):
            return never()
        if v.static in ("long", "double") and not math.isinf(y):
            test = _compare(v.c, op, F.lit(int(y) if v.static == "long" and y == int(y) and abs(y) < 2**53 else y))
            return test & ~F.isnan(v.num) if v.static == "double" else test
        return _compare(v.num, op, F.lit(y)) & ~F.isnan(v.num)
    text = F.coalesce(v.text, F.lit(""))
    if not isinstance(x, str):
        return never()
    if op == "matches":
        try:
            return text.rlike(translate(x))
        except ValueError:
            return never()
    inside = text.contains(x) if cs else F.lower(text).contains(x.lower())
    if v.static == "array":
        return F.when(v.null, inside).otherwise(v.has_element(x, cs))
    return F.when(v.kind == "array", v.has_element(x, cs)).otherwise(inside) if v.static == "dynamic" else inside


def _expression_equal(v: Value, x, cs: bool) -> Column:
    if x is None:
        return ~v.present | v.null
    if isinstance(x, bool):
        if v.static == "dynamic":
            return (v.kind == "bool") & (F.try_variant_get(v.v, "$", "boolean") == x)
        return v.c == F.lit(x) if v.static == "bool" else never()
    if isinstance(x, float):
        if v.static == "dynamic":
            return v.number == F.lit(x)
        if v.static == "long":
            return v.c == F.lit(int(x)) if not math.isinf(x) and x == x and x == int(x) and abs(x) < 2**53 else never()
        return v.c == F.lit(x) if v.static == "double" and x == x else never()
    if v.static == "string":
        test = _same(v.c, x, cs)
        return (test | v.null) if (x if cs else x.lower()) == "null" else test
    return v.present & _same(v.text, x, cs)
