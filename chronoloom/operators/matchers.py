"""Label matchers, compiled to Catalyst predicates.

A missing label equals the empty string.  No form uses ``coalesce``, so that
equality, IN, prefixes and null tests reach the Parquet reader.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import regex
from chronoloom.model import LABEL_PREFIX, col

EQUAL, NOT_EQUAL, REGEX, NOT_REGEX = "=", "!=", "=~", "!~"


@dataclass(frozen=True)
class Matcher:
    name: str
    kind: str
    value: str

    def __str__(self) -> str:
        column, quoted = LABEL_PREFIX + self.name, self.value.replace("\\", "\\\\").replace('"', '\\"')
        base = f'equal("{column}","{quoted}")' if self.kind in (EQUAL, NOT_EQUAL) else f"regex({column},{self.value})"
        return f"not({base})" if self.kind in (NOT_EQUAL, NOT_REGEX) else base

    def matches(self, value: str | None) -> bool:
        """The rule on one value; a missing label is the empty string."""
        value = value or ""
        if self.kind in (EQUAL, NOT_EQUAL):
            return (value == self.value) == (self.kind == EQUAL)
        if self.kind in (REGEX, NOT_REGEX):
            return regex.matches(self.value, value) == (self.kind == REGEX)
        raise ValueError(f"unsupported matcher type {self.kind!r}")


def eq(name: str, value: str) -> Matcher:
    return Matcher(name, EQUAL, value)


def neq(name: str, value: str) -> Matcher:
    return Matcher(name, NOT_EQUAL, value)


def re(name: str, value: str) -> Matcher:
    return Matcher(name, REGEX, value)


def nre(name: str, value: str) -> Matcher:
    return Matcher(name, NOT_REGEX, value)


def equal(c: Column, value: str) -> Column:
    return (c.isNull() | (c == "")) if value == "" else (c == value)


def not_equal(c: Column, value: str) -> Column:
    return (c.isNotNull() & (c != "")) if value == "" else (c.isNull() | (c != value))


def _one_of(c: Column, values: list[str]) -> Column:
    some = c.isin(values)
    return c.isNull() | some if "" in values else some


def regex_match(c: Column, pattern: str) -> Column:
    """True for whole matches; never null."""
    java = regex.anchored(pattern)  # refuses bad patterns, also those rewritten below
    if pattern == ".*":
        return F.lit(True)
    if pattern == ".+":
        return not_equal(c, "")
    values = regex.literal_set(pattern)
    if values is not None:
        return equal(c, values[0]) if len(values) == 1 else _one_of(c, values)
    if regex.matches(pattern, ""):
        return c.isNull() | c.rlike(java)
    prefix, rest = regex.literal_prefix(pattern)
    if prefix:
        starts = c.isNotNull() & F.startswith(c, F.lit(prefix))
        return starts if rest == ".*" else starts & c.rlike(java)
    return c.isNotNull() & c.rlike(java)


def not_regex_match(c: Column, pattern: str) -> Column:
    java = regex.anchored(pattern)
    if pattern == ".*":
        return F.lit(False)
    if pattern == ".+":
        return equal(c, "")
    values = regex.literal_set(pattern)
    if values is not None and len(values) == 1:
        return not_equal(c, values[0])
    if values is not None:
        return (c.isNotNull() if "" in values else c.isNull()) & ~c.isin(values) if "" in values else c.isNull() | ~c.isin(values)
    if regex.matches(pattern, ""):
        return c.isNotNull() & ~c.rlike(java)
    return c.isNull() | ~c.rlike(java)


_COMPILERS = {EQUAL: equal, NOT_EQUAL: not_equal, REGEX: regex_match, NOT_REGEX: not_regex_match}


def predicate(matcher: Matcher, columns: list[str]) -> Column:
    """The matcher as a column; a label that no row has is null everywhere."""
    if matcher.kind not in _COMPILERS:
        raise ValueError(f"unsupported matcher type {matcher.kind!r}")
    name = LABEL_PREFIX + matcher.name
    c = col(name) if name in columns else F.lit(None).cast("string")
    return _COMPILERS[matcher.kind](c, matcher.value)


def all_of(matchers: list[Matcher] | tuple[Matcher, ...], columns: list[str]) -> Column:
    """Conjunction; without matchers, all rows."""
    return reduce(lambda a, b: a & b, (predicate(m, columns) for m in matchers), F.lit(True))


_OPPOSITE = {EQUAL: NOT_EQUAL, NOT_EQUAL: EQUAL, REGEX: NOT_REGEX, NOT_REGEX: REGEX}

# The constraint interface: the same rules by their constructors.


@dataclass(frozen=True)
class Constraint:
    matcher: Matcher
    negated: bool = False

    def __str__(self) -> str:
        return f"not({self.matcher})" if self.negated else str(self.matcher)

    def column(self, columns: list[str]) -> Column:
        # the opposite kind, not NOT: a missing label must stay comparable
        m = Matcher(self.matcher.name, _OPPOSITE[self.matcher.kind], self.matcher.value) if self.negated else self.matcher
        return predicate(m, columns)


def Equal(path: str, value: str) -> Constraint:  # noqa: N802
    return Constraint(eq(path.removeprefix(LABEL_PREFIX), value))


def Regex(path: str, matcher: Matcher) -> Constraint:  # noqa: N802
    if matcher.kind != REGEX:
        raise ValueError("unsupported matcher type")
    return Constraint(Matcher(path.removeprefix(LABEL_PREFIX), REGEX, matcher.value))


def Not(c: Constraint) -> Constraint:  # noqa: N802
    return Constraint(c.matcher, not c.negated)


def Initialize(df: DataFrame, *constraints: Constraint) -> list[Column]:  # noqa: N802
    """Compiles on the driver; type and pattern errors show here.  Only string columns can be matched."""
    kinds = dict(df.dtypes)
    for c in constraints:
        if kinds.get(LABEL_PREFIX + c.matcher.name, "string") != "string":
            raise TypeError(f"{LABEL_PREFIX}{c.matcher.name} is no string column")
    return [c.column(df.columns) for c in constraints]


def Filter(df: DataFrame, *constraints: Constraint) -> DataFrame:  # noqa: N802
    return df.where(reduce(lambda a, b: a & b, Initialize(df, *constraints), F.lit(True)))
