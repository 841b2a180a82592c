"""Golden tables and a brute-force evaluator for matchers; regex dialect."""

import itertools
import re as pyre

import pytest

from chronoloom.functions import regex
from chronoloom.operators.matchers import Equal, Filter, Initialize, Matcher, Not, Regex, all_of, eq, neq, nre, re

T1 = [dict(zip("ABC", r)) for r in (("1", "2", "a"), ("3", "4", "b"), ("7", "12", "c"), ("9", "22", "d"), ("0", "1", "e"), ("7", "1", "f"), ("7", "1", "g"), ("0", "1", "h"))]
T2 = [dict(zip("AB", r)) for r in ("12", "13", "14", "14", "15", "15", "25", "25", "25", "35", "36", "32")]
T3 = [dict(zip("AB", r)) for r in ("11", "12", "21", "22", "11", "12", "21", "22")]
T4 = [{"C": c} for c in ("foo", "bar", "foo", "buz")]
T6 = [dict(zip("AB", r)) for r in ("11", "12")]
T7 = [{"A": "1", "C": "a"}, {"A": "2", "C": "b"}, {"A": "2"}, {"A": "3", "C": "b"}, {"A": "4"}, {"A": "5"}]
GOLDEN = [
    (T1, [eq("A", "7"), eq("C", "g")], [6]),
    (T1, [eq("A", "7"), neq("D", "")], []),
    (T1, [eq("A", "7")], [2, 5, 6]),
    (T1, [eq("A", "7"), neq("B", "1")], [2]),
    (T1, [eq("A", "7"), neq("C", "c")], [5, 6]),
    (T1, [neq("A", "227")], list(range(8))),
    (T1, [re("C", "a|c|d")], [0, 2, 3]),
    (T1, [re("C", ".*")], list(range(8))),
    (T2, [neq("A", "3")], list(range(9))),
    (T2, [neq("A", "3"), eq("B", "5")], [4, 5, 6, 7, 8]),
    (T2, [neq("A", "3"), neq("A", "1")], [6, 7, 8]),
    (T2, [eq("A", "2"), neq("B", "5")], []),
    (T2, [eq("A", "3"), neq("B", "2")], [9, 10]),
    (T3, [neq("A", "1"), neq("B", "2")], [2, 6]),
    (T4, [re("C", "f.*")], [0, 2]),
    (T4, [re("C", "b.*")], [1, 3]),
    (T4, [re("C", "f.*|b.*")], [0, 1, 2, 3]),
    (T6, [eq("A", "1"), eq("None", "?")], []),
    (T6, [eq("A", "1"), eq("None", "")], [0, 1]),
    (T6, [eq("A", "1"), re("None", "f.*|b.*")], []),
    (T6, [eq("A", "1"), re("None", "f.*|b.*|")], [0, 1]),
    (T7, [eq("C", "")], [2, 4, 5]),
    (T7, [eq("A", "2"), eq("C", "")], [2]),
]


def table(spark, rows):
    names = sorted({k for r in rows for k in r})
    schema = "row int, " + ", ".join(f"`l_{n}` string" for n in names)
    return spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)], schema)


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_golden(spark, case):
    rows, matchers, want = GOLDEN[case]
    df = table(spark, rows)
    assert sorted(r["row"] for r in df.where(all_of(matchers, df.columns)).collect()) == want


def test_against_brute_force(spark):
    values = [None, "", "a", "ab", "é", "a\n", "a\nb", "\n", "a|b", "A"]
    df = table(spark, [{"x": v} if v is not None else {"y": "z"} for v in values])
    patterns = ["", "a", "a|ab", "a|", ".*", ".+", "a.*", "a.+", "(?i)a", "a?", "(a|é)", "[^a]", "a\\|b", "a\nb", "a.b", "ab*", "é+"]
    for kind, value in itertools.product(("=", "!=", "=~", "!~"), patterns):
        m = Matcher("x", kind, value)
        hit = lambda v: (v == value) if "~" not in kind else pyre.fullmatch(f"(?s:{value})" if not value.startswith("(?i)") else f"(?si:{value[4:]})", v) is not None  # noqa: E731, B023
        want = [i for i, v in enumerate(values) if hit(v or "") != ("!" in kind)]
        got = sorted(r["row"] for r in df.where(all_of([m], df.columns)).collect())
        assert got == want, m
        assert [i for i, v in enumerate(values) if m.matches(v)] == want


def test_pushdown(spark, tmp_path):
    df = table(spark, T1)
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for m, text in ((eq("A", "7"), "EqualTo(l_A,7)"), (eq("C", ""), "IsNull(l_C)"), (re("C", "a|c"), "In(l_C"), (re("C", "ab.*"), "StringStartsWith(l_C,ab)")):
        plan = df.where(all_of([m], df.columns))._jdf.queryExecution().executedPlan().toString()
        assert text in plan.split("PushedFilters")[1].split("ReadSchema")[0]


def test_regex_dialect(spark):
    ok = {
        "(?P<n>a)b": ("ab", "a"),
        "[[:alpha:]]+": ("aZ", "a1"),
        "[[:^digit:]]": ("x", "1"),
        "a$": ("a", "a\n"),
        "[a&&b]+": ("&", "c"),
        "[[]": ("[", "]"),
        "\\pN": ("1", "a"),
        "\\p{Greek}": ("α", "a"),
        "\\s": (" ", "\x0b"),
        "\\Qa.b\\E": ("a.b", "axb"),
        "(?i:É)": ("é", "e"),
        "a{2,3}": ("aa", "a"),
        "x{": ("x{", "x"),
        "\\141": ("a", "b"),
        "(?U)a+": ("aa", "b"),
        "(?-s).": ("a", "\n"),
    }
    for pattern, (yes, no) in ok.items():
        assert regex.matches(pattern, yes) and not regex.matches(pattern, no), pattern
    for bad in ("(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(a)\\1", "a*+", "a++", "(?>a)", "\\C", "(", ")", "[a", "[[:nope:]]", "a{1001}", "a\\", "*", "\\Z"):
        with pytest.raises(regex.BadRegex):
            regex.anchored(bad)


def test_literal_sets_and_prefixes():
    assert regex.literal_set("a|b|c") == ["a", "b", "c"] and regex.literal_set("(a|b|)") == ["a", "b", ""]
    assert regex.literal_set("a\\.b|c") == ["a.b", "c"] and regex.literal_set("a.|b") is None and regex.literal_set("(a|b)c") is None
    assert regex.literal_prefix("ab.*") == ("ab", ".*") and regex.literal_prefix("ab*") == ("a", "b*") and regex.literal_prefix("a|b")[0] == ""
    assert regex.literal_prefix("(?i)ab")[0] == ""


def test_constraints(spark):
    df = table(spark, T7)
    assert sorted(r["row"] for r in Filter(df, Not(Equal("l_C", "b"))).collect()) == [0, 2, 4, 5]
    assert str(Not(Regex("l_C", re("C", "b.*")))) == "not(regex(l_C,b.*))" and str(eq("C", "b")) == 'equal("l_C","b")'
    assert [r["row"] for r in Filter(df, Not(Not(Equal("l_C", "a")))).collect()] == [0]
    with pytest.raises(ValueError):
        Regex("l_C", eq("C", "b"))
    with pytest.raises(ValueError):
        all_of([Matcher("C", "<", "b")], df.columns)
    with pytest.raises(TypeError):
        Initialize(spark.createDataFrame([(1,)], "l_C int"), Equal("l_C", "1"))
    assert nre("a", "b").kind == "!~"
