"""PII: format-preserving Feistel pseudonyms.

Validated items of a text are replaced by a keyed permutation of themselves
within their own format, so a value maps to one pseudonym in every document,
distinct values to distinct ones, and the pseudonym can be undone with the key:

* card numbers (Luhn): the first six digits' place, separators and length stay;
  the payload digits are permuted and the check digit is made anew;
* phone numbers: all digits behind the country code are permuted, separators stay;
* IPv4 addresses: permuted among all addresses;
* calendar dates (2024-05-17, 17.05.2024, 05/17/2024): permuted among the days
  of 1900 to 2099, in the same notation;
* social security numbers (not 000, 666, 9xx; group and serial not 0);
* IBANs (modulo 97): letters and digits permuted in their places, the check
  digits made anew;
* e-mail addresses: the local part is permuted, letters to letters and digits to
  digits;
* secrets (access keys by their known prefixes, ``token=``, ``api_key:`` and the
  like): characters behind the prefix are permuted by class.

The permutation is a balanced or unbalanced Feistel network over mixed-radix
numbers (10 rounds of keyed BLAKE2b), with cycle walking where the domain is
smaller than the product of the two halves.

Edge cases: a null text stays null, with no items; empty texts stay empty.
Numbers that fail their check are left alone; a card is
also found among other groups of digits.  Repeated rows get equal results;
nulls and clashing names in other columns do no harm, as only the id and the
text are read.  Very long texts are searched whole.  Empty tables give no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import small_batches

ROUNDS = 10
#: Permutations of a run's cards until they are found in the same places; beyond, the run can't be undone.
CARD_WALK = 2000
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """A keyed permutation of 0..size-1 for any size, by two unequal halves."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.left = size, math.isqrt(max(size - 1, 0)) + 1
        self.right = -(-size // self.left)
        self.key, self.tweak = key, tweak.encode()

    def _round(self, i: int, x: int) -> int:
        """A number drawn from a keyed hash, 16 bytes longer than a half, so that its remainder is even."""
        number = x.to_bytes((x.bit_length() + 7) // 8, "big")
        data = len(self.tweak).to_bytes(4, "big") + self.tweak + bytes([i]) + number
        out = b""
        for block in range(-(-((max(self.left, self.right).bit_length() + 7) // 8 + 16) // 64)):
            out += hashlib.blake2b(block.to_bytes(4, "big") + data, key=self.key).digest()
        return int.from_bytes(out, "big")

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * self._round(i, a)) % self.right
            else:
                a = (a + sign * self._round(i, b)) % self.left
        return a * self.right + b

    def permute(self, x: int, back: bool = False) -> int:
        if self.size < 2:
            return x
        x = self._once(x, back)
        while x >= self.size:  # walk the cycle until back inside
            x = self._once(x, back)
        return x


def by_class(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Permutes letters and digits, each within its class; all else stays in place."""
    sets = [next((s for s in (DIGITS, UPPER, LOWER) if c in s), "") for c in text]
    size, value = 1, 0
    for c, s in zip(text, sets):
        if s:
            size *= len(s)
            value = value * len(s) + s.index(c)
    if size == 1:
        return text
    shape = "".join(s[0] if s else c for c, s in zip(text, sets))
    value = Feistel(key, f"{tweak}:{shape}", size).permute(value, back)
    out = []
    for c, s in zip(reversed(text), reversed(sets)):
        if s:
            value, r = divmod(value, len(s))
            c = s[r]
        out.append(c)
    return "".join(reversed(out))


def put_digits(shape: str, digits: str) -> str:
    """The digits in the places that digits have in ``shape``."""
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in shape)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total


def valid_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn_sum(digits) % 10 == 0


def card(text: str, key: bytes, back: bool) -> str | None:
    digits = only_digits(text)
    if not valid_card(digits):
        return None
    body = by_class(digits[:-1], key, "card", back)
    while len(set(body)) == 1 and luhn_sum(body + "0") % 10 == (10 - int(body[0])) % 10:
        body = by_class(body, key, "card", back)  # a number of equal digits is no card
    return put_digits(text, body + str(-luhn_sum(body + "0") % 10))


def card_spans(run: str) -> list[tuple[int, int]]:
    """The cards in a run of digits, blanks and hyphens: whole groups of digits, leftmost and longest first."""
    groups = [m.span() for m in re.finditer("[0-9]+", run)]
    out, i = [], 0
    while i < len(groups):
        n, ends = 0, []
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            if n >= 13:
                ends.append(j)
        for j in reversed(ends):
            if valid_card(only_digits(run[groups[i][0] : groups[j][1]])):
                out.append((groups[i][0], groups[j][1]))
                i = j
                break
        i += 1
    return out


def cards(run: str, key: bytes, back: bool) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) of the cards in a run, which are found in the same places again."""
    spans = card_spans(run)
    new = run
    for _ in range(CARD_WALK // max(1, len(spans)) + 1 if spans else 0):
        parts, at = [], 0
        for s, e in spans:
            parts += [new[at:s], card(new[s:e], key, back)]
            at = e
        new = "".join([*parts, new[at:]])
        if card_spans(new) == spans:
            break
    return [(s, e, new[s:e]) for s, e in spans]


def phone(text: str, key: bytes, back: bool) -> str | None:
    m = re.match(r"\+[0-9]{1,3}(?=[ .(-])|", text)
    head, tail = text[: m.end()], text[m.end() :]
    if not 7 <= len(only_digits(tail)) <= 12:
        return None
    return head + put_digits(tail, by_class(only_digits(tail), key, "phone" + only_digits(head), back))


def ipv4(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, Feistel(key, "ipv4", 1 << 32).permute(n, back).to_bytes(4, "big")))


def date(text: str, key: bytes, back: bool) -> str | None:
    nums, sep = re.split(r"[-./]", text), re.search(r"[-./]", text).group()
    order = "ymd" if len(nums[0]) == 4 else "dmy" if sep == "." else "mdy"
    part = dict(zip(order, map(int, nums)))
    try:
        day = datetime.date(part["y"], part["m"], part["d"]).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day <= LAST_DAY - FIRST_DAY:
        return None
    new = datetime.date.fromordinal(Feistel(key, "date", LAST_DAY - FIRST_DAY + 1).permute(day, back) + FIRST_DAY)
    return sep.join({"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}[o] for o in order)


def ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    rank = area - 1 - (area > 666)
    n = Feistel(key, "ssn", 898 * 99 * 9999).permute((rank * 99 + group - 1) * 9999 + serial - 1, back)
    n, serial = divmod(n, 9999)
    rank, group = divmod(n, 99)
    return f"{rank + 1 + (rank >= 665):03}-{group + 1:02}-{serial + 1:04}"


def iban_number(bare: str) -> int:
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4]))


def iban(text: str, key: bytes, back: bool) -> str | None:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34 or iban_number(bare) % 97 != 1:
        return None
    body = by_class(bare[4:], key, "iban" + bare[:2], back)
    check = 98 - iban_number(bare[:2] + "00" + body) % 97
    left = iter(f"{bare[:2]}{check:02}{body}")
    return "".join(c if c == " " else next(left) for c in text)


def email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    return by_class(local, key, "email@" + domain.lower(), back) + "@" + domain


def secret(text: str, key: bytes, back: bool) -> str | None:
    m = re.match(_SECRET_HEAD, text)
    return text[: m.end()] + by_class(text[m.end() :], key, "secret", back)


#: The usual heads of access keys and of assigned secrets.
_KEY_HEAD = r"AKIA|ASIA|gh[pousr]_|github_pat_|sk_live_|sk_test_|sk-|xox[abprs]-|glpat-|AIza"
_SECRET_HEAD = (
    r"(?:" + _KEY_HEAD + r"|"
    r"(?i:(?:api|access|secret|private|auth)?[_-]?(?:key|token|secret|password|passwd|pwd)\s{0,2}[=:]\s{0,2}[\"']?))"
)
KINDS = (
    ("secret", r"(?<![A-Za-z0-9])" + _SECRET_HEAD + r"[A-Za-z0-9_\-/+]{8,}", secret),
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w@])", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9])", date),
    ("ipv4", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])", ipv4),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn),
    ("card", r"(?<![0-9.])[0-9](?:[ -]?[0-9]){12,}(?![0-9])", cards),
    ("phone", r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", phone),
)
#: Texts without an ASCII digit, @ or a secret's head hold nothing; most lines are skipped by it.
_CANDIDATE = re.compile(r"[0-9@]|(?i:key|token|secret|passw|pwd)|(?<![A-Za-z0-9])(?:" + _KEY_HEAD + ")")
_BLANK = re.compile(r"\s")
_ANY = [(kind, re.compile(pattern), f) for kind, pattern, f in KINDS]


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Runs of the text, cut at words without candidates, in which items can lie."""
    start = end = None
    for m in _CANDIDATE.finditer(text):
        lo = max(0, m.start() - 120)
        if end is not None and lo <= end:
            end = m.end() + 120
        else:
            if end is not None:
                yield start, end
            start, end = lo, m.end() + 120
    if end is not None:
        yield start, end


def find(text: str, key: bytes, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym), without overlaps, in order; earlier kinds win."""
    taken: list[tuple[int, int, str, str]] = []
    for lo, hi in _stretches(text):
        gap = _BLANK.search(text, min(hi + 200, len(text)))  # never cut inside a word
        end = gap.start() if gap else len(text)
        own: list[tuple[int, int, str, str]] = []
        for kind, pattern, replace in _ANY:
            for m in pattern.finditer(text, max(lo, taken[-1][1] if taken else 0), end):
                if kind == "card":  # in what other items leave of the run
                    at, parts = m.start(), []
                    for s, e in sorted((s, e) for s, e, _, _ in own if s < m.end() and m.start() < e) + [(m.end(), m.end())]:
                        parts += [(at + a, at + b, kind, new) for a, b, new in cards(text[at : max(at, s)], key, back)]
                        at = max(at, e)
                    own += parts
                    continue
                if any(m.start() < e and s < m.end() for s, e, _, _ in own):
                    continue
                new = replace(m.group(), key, back)
                if new is not None:
                    own.append((m.start(), m.end(), kind, new))
        taken += sorted(own)
    return taken


def replace_all(text: str, key: bytes, back: bool = False) -> tuple[str, list[str]]:
    parts, kinds, at = [], [], 0
    for start, end, kind, new in find(text, key, back):
        parts += [text[at:start], new]
        kinds.append(kind)
        at = end
    return "".join([*parts, text[at:]]) if parts else text, kinds


def pseudonymise(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_items, kinds) per row: the text with pseudonyms, and the sorted kinds found."""
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, n, kinds = [], [], []
            for t in b.column("t"):
                t = t.as_py()
                new, found = (None, []) if t is None else replace_all(t, key)
                text.append(new), n.append(len(found)), kinds.append(",".join(sorted(set(found))))
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.string())], names=["d", "t", "n", "k"]
            )

    src = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"d {src.schema['d'].dataType.simpleString()}, t string, n long, k string").select(
        F.col("d").alias(id_col), F.col("t").alias(text_col), F.col("n").alias("n_items"), F.col("k").alias("kinds")
    )
