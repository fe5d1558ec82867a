from datetime import UTC, datetime

import pytest

from timberline.lang import ast as A
from timberline.lang import directives
from timberline.lang.errors import QueryError
from timberline.lang.parser import parse
from timberline.lang.printer import text

GOOD = [
    "error",
    '"connection reset"',
    "error timeout",
    "error OR warn AND NOT debug",
    "NOT (a b) or c",
    "level=error",
    'level!="very bad"',
    "status>=500 AND status<600",
    "host=*",
    "*=timeout",
    "err*",
    "k*=v?",
    "host=web-[12]",
    "/err(or)?\\/x/",
    "len(msg) > 100",
    "*",
    '"and"',
    "a=1 | where b=2 c | eval x = 1 + 2 * -y, z=round(x/3, 1) % 2 | sort -x, y | head 3",
    "| stats count",
    '| stats count as n, avg(value) as v, dcount(a) by user, bin(5m), "odd name"',
    "| stats sum(a + b), values(x) by bin(0.5h, source_ts)",
    "| timechart 24 by level",
    "| timechart 0",
    "a | tail 5 | slice 2 4 | rename a as b, c as d | fields - x, y | fields p",
    "a | dedup 5s | lookup hosts ip port | raw",
    "| stats count by a | barchart",
    "| stats count by lat, lon | map scatter lat lon",
    "| stats count by c | map choropleth c",
    "| scatter x y",
    "a | export cold",
    "x=1 # a comment\n| head 2 # another",
    '| eval a = concat("x \\"q\\"", b) | where concat(a) = x',
]

BAD = ["", "*=*", "(a", "a)", "/(/", "/a\\1/", "a!=b*", "*!=a", "k>*", "host=[", "| stats foo(x)", "| stats count as n, sum(x) as n", "| stats count by bin(5)", "| stats count by bin(-1m)",
       "| head 0", "| head x", "| slice 3 2", "| bogus", "| count", "| eval x = nope(1)", "| eval x = len()", "| eval x = pow(1)", "a | export b | head 1", "| stats count | stats count",
       "| stats count | timechart 3", "| stats count | dedup", "| stats count | export x", "| barchart | donut", '"open', '"bad \\q"', "a |", "| rename a b", "AND", "a OR", "level=", "| stats sum"]


@pytest.mark.parametrize("q", GOOD)
def test_round_trip(q):
    tree = parse(q)
    assert parse(text(tree)) == tree


@pytest.mark.parametrize("q", BAD)
def test_errors(q):
    with pytest.raises(QueryError):
        parse(q)


def test_precedence():
    assert parse("a OR b c").filter == A.Or((A.Token("a"), A.And((A.Token("b"), A.Token("c")))))
    assert parse("NOT a b").filter == A.And((A.Not(A.Token("a")), A.Token("b")))
    e = parse("| eval x = 1 + 2 * 3 - 4").pipes[0].assignments[0][1]
    assert text(A.Query(None, (A.Eval((("x", e),)),))) == "| eval x = (1 + (2 * 3)) - 4"


def test_modes():
    assert parse("a/b/").filter  # a regex follows
    assert parse("| eval r = a / b").pipes[0].assignments[0][1] == A.Binary("/", A.Field("a"), A.Field("b"))
    assert parse("| eval r = a-b").pipes[0].assignments[0][1] == A.Field("a-b")
    assert parse("| stats count").pipes[0].aggregates[0] == A.Aggregate("count", None, "count")
    assert parse("| stats avg(x)").pipes[0].aggregates[0].alias == "avg_x"


def test_directives():
    now = datetime(2025, 1, 2, tzinfo=UTC)
    d, rest = directives.split('last=1h reverse=true level=x "limit=3" limit=7 order=source_ts | where start=1', now)
    assert (d.start, d.end, d.reverse, d.limit, d.order) == (datetime(2025, 1, 1, 23, tzinfo=UTC), now, True, 7, "source_ts")
    assert rest.split() == ["level=x", '"limit=3"', "|", "where", "start=1"]
    assert directives.split("start=2025-01-01T00:00:00Z end=1735776000 x")[0].end == datetime(2025, 1, 2, tzinfo=UTC)
    assert directives.split("last=all")[0].start is None
    for bad in ("limit=x", "start=yesterday", "last=5x", "order=foo", "reverse=maybe"):
        with pytest.raises(QueryError):
            directives.split(bad)
