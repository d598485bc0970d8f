"""Parsers of both languages."""

import pytest

from rowsift import lang
from rowsift.errors import QueryError
from rowsift.lang import expression, keyword
from rowsift.plans.nodes import And, Arith, CountAll, CountBy, CountByTime, CountUnique, Dedup, Exists, ExpressionTest, FieldRef, Fields, Filter, KeywordTest, Limit, MapExpr, Not, Number, Or, Project, Skip, Sort, Stat, TextFn, TimeAttr, TypeCount
from rowsift.plans.normalize import is_streamable, normalize


def nodes(text, **kw):
    return lang.parse(text, **kw).nodes


@pytest.mark.parametrize(
    "text,node",
    [
        ("where a=1", KeywordTest("a", "=", "1")),
        ("where a!=1", KeywordTest("a", "!=", "1")),
        ("where a>1", KeywordTest("a", ">", "1")),
        ("where a>=1", KeywordTest("a", ">=", "1")),
        ("where a~=x.*y", KeywordTest("a", "~=", "x.*y")),
        ("where a gt 5", KeywordTest("a", ">", "5")),
        ("where a lte 5", KeywordTest("a", "<=", "5")),
        ("where a contains 'two words'", KeywordTest("a", "contains", "two words")),
        ("where a glob er?or*", KeywordTest("a", "glob", "er?or*")),
        ("where a between 1 9", KeywordTest("a", "between", "1", "9")),
        ("where a exists", Exists("a")),
        ("where a=b=c", KeywordTest("a", "=", "b=c")),
    ],
)
def test_keyword_tests(text, node):
    assert nodes(text) == (Filter(node),)


def test_keyword_connectors_run_left_to_right():
    a, b, c = (KeywordTest(x, "=", "1") for x in "abc")
    assert nodes("where a=1 or b=1 and c=1") == (Filter(And(Or(a, b), c)),)
    assert nodes("where a=1, b=1 or c=1") == (Filter(Or(And(a, b), c)),)
    assert nodes("where a=1 where b=1") == (Filter(And(a, b)),)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("count", (CountAll(),)),
        ("count by a b", (CountBy(("a", "b")),)),
        ("count by 5m", (CountByTime("ts", "5m", False),)),
        ("count by hour at asc", (CountByTime("at", "hour", True),)),
        ("count unique a", (CountUnique("a", True),)),
        ("count types a", (TypeCount("a"),)),
        ("fields", (Fields(),)),
        ("avg a", (Stat("avg", "a", True),)),
        ("select a b sort a desc limit 3", (Project(("a", "b")), Sort("a", True), Limit(3))),
        ("head 4", (Limit(4),)),
    ],
)
def test_keyword_clauses(text, expected):
    assert nodes(text) == expected


def test_keyword_files_and_flags():
    plan = lang.parse("-S where a=1 x.log y.json")
    assert plan.files == ("x.log", "y.json") and plan.case_sensitive
    assert lang.parse("count by service app.log").files == ("app.log",)


@pytest.mark.parametrize("text", ["where", "where a==1", "where a", "where a ~ b", "sort", "sort a up", "limit x", "limit", "sum", "where a~=(", "where a='x"])
def test_keyword_errors(text):
    with pytest.raises(QueryError):
        lang.parse(text)


def test_error_has_a_caret_and_a_hint():
    with pytest.raises(QueryError) as e:
        keyword.parse("where level==error")
    assert "single '='" in e.value.hint and "^" in str(e.value)
    with pytest.raises(QueryError) as e:
        expression.parse('.a == 1 | pik(.a)')
    assert "pick" in e.value.hint


def test_expression_precedence():
    a, b, c = (ExpressionTest(x, "==", 1.0) for x in "abc")
    assert nodes(".a == 1 or .b == 1 and .c == 1") == (Filter(Or(a, And(b, c))),)
    assert nodes("not .a == 1 and .b == 1") == (Filter(And(Not(a), b)),)


@pytest.mark.parametrize(
    "text,expected",
    [
        ('.a == "x"', (Filter(ExpressionTest("a", "==", "x")),)),
        (".a.b == true", (Filter(ExpressionTest("a.b", "==", True)),)),
        (".a == null", (Filter(ExpressionTest("a", "==", None)),)),
        (".a exists", (Filter(Exists("a")),)),
        ("| pick(.a, .b.c)", (Project(("a", "b.c")),)),
        ("| sort_by(.a desc) | skip(2) | limit(3)", (Sort("a", True), Skip(2), Limit(3))),
        ("| dedup(.a)", (Dedup("a"),)),
        ('| group_by_time(.ts, "5m")', (CountByTime("ts", "5m", True),)),
        ("| hour_of_day(.ts)", (TimeAttr("hour_of_day", "ts"),)),
        ('| replace(.a, "x", "y")', (TextFn("replace", "a", ("x", "y")),)),
        ("| map(.r = .a + .b * 2)", (MapExpr("r", Arith(FieldRef("a"), "+", Arith(FieldRef("b"), "*", Number(2.0)))),)),
        ("| count_unique(.a)", (CountUnique("a", False),)),
    ],
)
def test_expression_stages(text, expected):
    assert nodes(text) == expected


@pytest.mark.parametrize("text", [".a ==", ".a = 1", "| pick()", "| nosuch(.a)", "| limit(x)", '| group_by_time(.ts, "5x")', "| map(.a = )", '.a == "x', "| split(.a)"])
def test_expression_errors(text):
    with pytest.raises(QueryError):
        lang.parse(text)


def test_router():
    assert [lang.layer_of(x) for x in (".a exists", "| count()", "not .a exists", "where a=1", "nothing")] == ["expression"] * 3 + ["keyword"] * 2


def test_normalisation_drops_what_is_ignored():
    plan = normalize(lang.parse("where a=1 count by b sort b limit 3"))
    assert [type(n) for n in plan.nodes] == [Filter, CountBy] and plan.warnings
    assert is_streamable(lang.parse("where a=1 select b limit 2")) and not is_streamable(lang.parse("sort a"))
