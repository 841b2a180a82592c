"""From RE2 syntax, as matchers use it, to patterns of the JVM.

Patterns are fully anchored and ``.`` matches line ends.  Syntax that RE2
refuses is refused here too, on the driver, before any job runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class BadRegex(ValueError):
    pass


# POSIX classes and their JVM names.
POSIX = {
    "alnum": "\\p{Alnum}",
    "alpha": "\\p{Alpha}",
    "ascii": "\\p{ASCII}",
    "blank": "\\p{Blank}",
    "cntrl": "\\p{Cntrl}",
    "digit": "\\p{Digit}",
    "graph": "\\p{Graph}",
    "lower": "\\p{Lower}",
    "print": "\\p{Print}",
    "punct": "\\p{Punct}",
    "space": "\\p{Space}",
    "upper": "\\p{Upper}",
    "word": "\\w",
    "xdigit": "\\p{XDigit}",
}
_META = set("\\.+*?()|[]{}^$")
_SPACE = "\\t\\n\\f\\r "


@dataclass
class _Reader:
    text: str
    at: int = 0

    def rest(self) -> str:
        return self.text[self.at :]

    def take(self, n: int = 1) -> str:
        part = self.text[self.at : self.at + n]
        self.at += n
        return part


def _escape(r: _Reader, in_class: bool) -> str:
    r.take()
    c = r.take()
    if not c:
        raise BadRegex("trailing backslash")
    if c in "CGRXZkKhHvVNe":
        raise BadRegex(f"unsupported escape \\{c}")
    if c in "123456789":
        m = re.match(r"[0-7]{1,2}", r.rest())
        if c > "7" or not m:
            raise BadRegex("back-references are not supported")
        return "\\0" + c + r.take(len(m.group()))
    if c == "0":
        m = re.match(r"[0-7]{0,2}", r.rest())
        return "\\0" + ("0" if not m.group() else r.take(len(m.group())))
    if c in "sS":
        inner = _SPACE if c == "s" else f"^{_SPACE}"
        return inner if in_class and c == "s" else f"[{inner}]"
    if c in "pP":
        m = re.match(r"\{(\^?)(\w+)\}|(\w)", r.rest())
        if not m:
            raise BadRegex("bad character class")
        r.take(len(m.group()))
        name, inverted = m[2] or m[3], (c == "P") != bool(m[1])
        return "\\" + ("P" if inverted else "p") + "{" + (name if len(name) <= 2 else "Is" + name) + "}"
    if c == "Q":
        end = r.text.find("\\E", r.at)
        literal = r.text[r.at : end if end >= 0 else len(r.text)]
        r.at = end + 2 if end >= 0 else len(r.text)
        return "".join("\\" + x if x in _META or x in "&-~" else x for x in literal)
    if c in "AzbB" and in_class:
        raise BadRegex(f"bad escape \\{c} in a class")
    if c.isalpha() and c not in "AzbBdDwWafnrtvx":
        raise BadRegex(f"unsupported escape \\{c}")
    return "\\" + c


def _class(r: _Reader) -> str:
    out = r.take()
    if r.rest().startswith("^"):
        out += r.take()
    first = True
    while True:
        rest = r.rest()
        if not rest:
            raise BadRegex("missing ]")
        if rest[0] == "]" and not first:
            return out + r.take()
        first = False
        if m := re.match(r"\[:(\^?)(\w+):\]", rest):
            if m[2] not in POSIX:
                raise BadRegex(f"unknown class {m[2]}")
            r.take(len(m.group()))
            name = POSIX[m[2]]
            out += name if not m[1] else f"[^{name}]"
        elif rest[0] == "\\":
            out += _escape(r, True)
        else:
            c = r.take()
            out += "\\" + c if c in "[]&" else c


def translate(pattern: str) -> str:
    """The unanchored pattern for the JVM."""
    r, out, depth = _Reader(pattern), [], 0
    multiline = False
    while rest := r.rest():
        c = rest[0]
        if c == "\\":
            out.append(_escape(r, False))
        elif c == "[":
            out.append(_class(r))
        elif m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", rest):
            depth += 1
            r.take(len(m.group()))
            out.append("(")
        elif m := re.match(r"\(\?([imsU]*)(-[imsU]+)?([:)])", rest):
            r.take(len(m.group()))
            on, off = m[1].replace("U", ""), (m[2] or "").replace("U", "")
            multiline |= "m" in on
            depth += m[3] == ":"
            flags = on.replace("i", "iu") + (off if len(off) > 1 else "")
            out.append(f"(?{flags}{m[3]}" if flags or m[3] == ":" else "")
        elif rest.startswith("(?"):
            raise BadRegex("look-around and other extensions are not supported")
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                raise BadRegex("unexpected )")
            out.append(r.take())
        elif m := re.match(r"[*+?]\+|\{\d+(?:,\d*)?\}\+", rest):
            raise BadRegex("possessive repetition is not supported")
        elif m := re.match(r"\{(\d+)(?:,(\d*))?\}", rest):
            if max(int(m[1]), int(m[2] or 0)) > 1000:
                raise BadRegex("repeat count over 1000")
            out.append(r.take(len(m.group())))
        elif c in "{}":
            out.append("\\" + r.take())
        elif c == "$" and not multiline:
            r.take()
            out.append("\\z")
        else:
            out.append(r.take())
    if depth:
        raise BadRegex("missing )")
    return "".join(out)


def anchored(pattern: str) -> str:
    """The pattern for ``rlike`` that matches whole values only."""
    java = f"\\A(?s:{translate(pattern)})\\z"
    _compile(java)
    return java


def _compile(java: str):
    """The JVM's pattern, or BadRegex."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        return spark._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, IllegalArgumentException) as e:
        raise BadRegex(f"the JVM refuses {java!r}: {e}") from None


def matches(pattern: str, value: str) -> bool:
    return bool(_compile(anchored(pattern)).matcher(value).matches())


def _literal(text: str) -> str | None:
    """The text that a pattern without operators stands for."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
            if at == len(text) or text[at].isalnum():
                return None
            c = text[at]
        elif c in _META:
            return None
        out.append(c)
        at += 1
    return "".join(out)


def _bars(text: str) -> list[int]:
    """Places of the bars that no backslash stands before; escapes are read from the left."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "|":
            out.append(at)
        at += 2 if text[at] == "\\" else 1
    return out


def literal_set(pattern: str) -> list[str] | None:
    """The values of a pattern that is an alternation of literals, with or without one group."""
    m = re.fullmatch(r"\((?:\?:)?([^()]*)\)", pattern)
    body = m[1] if m else pattern
    edges = [-1, *_bars(body), len(body)]
    parts = [_literal(body[a + 1 : b]) for a, b in zip(edges, edges[1:])]
    return None if any(p is None for p in parts) else list(dict.fromkeys(parts))


def literal_prefix(pattern: str) -> tuple[str, str]:
    """(prefix, rest): every match starts with the literal prefix."""
    if _bars(pattern) or re.search(r"\(\?[a-zA-Z-]*i", pattern):
        return "", pattern
    at = 0
    while at < len(pattern) and pattern[at] not in _META:
        at += 1
    if at < len(pattern) and pattern[at] in "*?{" and at:
        at -= 1  # the last character is repeated, perhaps not at all
    return pattern[:at], pattern[at:]
