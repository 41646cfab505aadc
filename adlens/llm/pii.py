"""PII: format-preserving Feistel pseudonyms.

A value that its format's rules confirm (a calendar date, a card number with a
right check digit, an address of four octets, ...) is an element of the finite
set of all values of that format.  A keyed Feistel network permutes the set:
the value's number is split into halves that are mixed in turn, and the walk
goes on until it is back in the set.  The result is again a valid value of the
same format, with the same punctuation and letter case; equal values get equal
pseudonyms in every document, other values others; with the key the
permutation can be undone (:func:`restore`).  The network's image is moved on by one before it is
mapped back, which leaves no value in place: what is counted has changed.

Digits of any script are digits: a number in one script is mapped as its value and written in that script
again; one that mixes scripts is no value.  Letters of an address stay in their
script and case (``ALPHABET`` neighbouring code points of one category).

Kinds: e-mail addresses (every label but the last, letters and digits within
their classes), IBANs (check digits renewed, 02 to 98 as the standard has them), IPv4 and IPv6 addresses (of the latter
the hexadecimal digits that are written, at least one of them decimal), dates, US social
security numbers, telephone numbers (country code kept), card and account
numbers of 13 to 19 digits with a right check digit (it stays right; numbers
with a wrong one are no values and stay as they are), and hexadecimal secrets
of 32 digits and more.

An IBAN ends where its country says, whatever upper-case words or numbers
follow; what only looks like one is scanned again for the other kinds and from
the next word on.

Texts are scanned whole and one by one in the task that reads them; there is
no shuffle.  Null texts stay null, empty ones empty; repeated rows are treated
alike; an empty table gives an empty result.  All columns are kept, the text
replaced, and one count per kind is added (replacing columns of those names)
where asked.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import map_batches

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "number", "secret")
ROUNDS = 8
#: Values whose pseudonyms a worker remembers.
REMEMBERED = 200_000

_DAY0, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()

# The shapes of the kinds, tried in this order.
PATTERNS = {
    "email": r"[^\W_][\w.%+-]*@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)|(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![\w:]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\w/-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
             r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "number": r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "secret": r"(?<!\w)[0-9a-fA-F]{32,}(?!\w)",
}
#: Characters of an IBAN by country; with other countries' codes all lengths are tried.
IBAN_LENGTHS = {code: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for code in codes.split()}
_AFTER_IBAN = {k: re.compile(PATTERNS[k]) for k in KINDS[KINDS.index("iban") + 1:]}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_WORTH = re.compile(r"[@\d]|[0-9a-fA-F]{32}")


class Feistel:
    """Keyed permutations of ``range(n)`` for any n, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, r: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        h = hashlib.blake2b(half.to_bytes(size, "little"), key=self.key, digest_size=min(64, size + 8),
                            person=bytes([r]) + hashlib.blake2b(tweak, digest_size=15).digest())
        return int.from_bytes(h.digest(), "little") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: bytes, member=None, back: bool = False) -> int:
        """Image of ``x`` (with ``back``: what it is the image of).  ``member``
        narrows the set to the numbers it accepts, ``x`` among them.

        The image is the number whose place in the network's order is one behind that of ``x``: all
        numbers are one cycle, so only a set of one has a number that stays.
        """
        if n < 2:
            return x
        tweak = tweak + b"/" + str(n).encode()
        place = self._walk(x, n, tweak, False)
        while True:
            place = (place + (-1 if back else 1)) % n
            x = self._walk(place, n, tweak, True)
            if member is None or member(x):
                return x

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        """The network on numbers of as many bits as ``n`` needs, until it is below ``n`` again."""
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            if back:
                for r in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(tweak, r, left, bits), left
            else:
                for r in range(ROUNDS):
                    left, right = right, left ^ self._round(tweak, r, right, bits)
            x = left << bits | right
            if x < n:
                return x


def luhn(digits: str) -> bool:
    """Whether the last digit is the right check digit."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        k = int(d) * (1 + i % 2)
        total += k - 9 if k > 9 else k
    return total % 10 == 0


def _check_digit(payload: str) -> str:
    return next(d for d in "0123456789" if luhn(payload + d))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban_ends(shape: str) -> list[int]:
    """Where an IBAN that begins the matched shape can end: after as many characters
    as its country has, or at the end; without a known country after any group, the last first."""
    ends = [i for i in range(len(shape), 0, -1) if i == len(shape) or shape[i] == " "]
    length = IBAN_LENGTHS.get(shape[:2])
    if length is None:
        return ends
    return [i for i in ends if i - shape.count(" ", 0, i) == length] + ends[:1]


@lru_cache(maxsize=1)
def _alphabets() -> dict[str, str]:
    """Class of each character that a label may change within."""
    lower = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
    upper = [chr(c) for c in range(0xC0, 0xDF) if c != 0xD7]
    sets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "".join(lower), "".join(upper)]
    return {c: s for s in sets for c in s}


#: Code points among which a letter outside Latin-1 is exchanged.
ALPHABET = 64


@lru_cache(maxsize=100_000)
def _alphabet(c: str) -> str | None:
    """The characters that ``c`` may become: digits of its script, letters of its category next to it."""
    if c in _alphabets():
        return _alphabets()[c]
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    kind = unicodedata.category(c)
    if kind[0] != "L":
        return None
    first = ord(c) - ord(c) % ALPHABET
    return "".join(x for x in map(chr, range(first, first + ALPHABET))
                   if unicodedata.category(x) == kind and x not in _alphabets())


_HEX = {c: "0123456789" if c.isdigit() else "abcdef" if c.islower() else "ABCDEF" for c in "0123456789abcdefABCDEF"}

class Pseudonyms:
    """Replaces the values of all kinds in texts, under one key."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back, self.known = Feistel(key), back, {}

    def _mixed(self, text: str, tweak: bytes, classes: dict[str, str] | None = None, fixed: int = 0,
               member=None) -> str:
        """Permute the characters that have a class, each within its class."""
        class_of = classes.get if classes else _alphabet
        n, x = 1, 0
        shape = []
        for c in text[fixed:]:
            s = class_of(c)
            shape.append(s)
            if s:
                x, n = x * len(s) + s.index(c), n * len(s)
        tweak += b":" + "".join(s[0] if s else c for s, c in zip(shape, text[fixed:])).encode()

        def spell(y: int) -> str:
            out = []
            for s, c in zip(reversed(shape), reversed(text[fixed:])):
                if s:
                    y, k = divmod(y, len(s))
                    c = s[k]
                out.append(c)
            return text[:fixed] + "".join(reversed(out))

        return spell(self.feistel.permute(x, n, tweak, member and (lambda y: member(spell(y))), self.back))

    @staticmethod
    def _digits(text: str, permuted) -> str:
        """Replace the digits of ``text`` by ``permuted(digits)``, punctuation kept."""
        new = iter(permuted("".join(c for c in text if c.isdigit())))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def email(self, s: str) -> str:
        local, domain = s.rsplit("@", 1)
        labels = domain.split(".")
        return (self._mixed(local, b"local") + "@"
                + ".".join([*(self._mixed(x, b"label") for x in labels[:-1]), labels[-1]]))

    def iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        if not 15 <= len(plain) <= 34 or not "02" <= plain[2:4] <= "98" or _mod97(plain) != 1:
            return None
        new = self._mixed(plain, b"iban", fixed=4)
        new = new[:2] + f"{98 - _mod97(new[:2] + '00' + new[4:]):02d}" + new[4:]
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in s)

    def ip(self, s: str) -> str | None:
        if ":" in s:
            try:
                ipaddress.IPv6Address(s)
            except ValueError:
                return None
            return self._mixed(s, b"ipv6", _HEX) if any(c.isdigit() for c in s) else None
        parts = [int(p) for p in s.split(".")]
        if max(parts) > 255:
            return None
        x = int.from_bytes(bytes(parts), "big")
        return ".".join(map(str, self.feistel.permute(x, 1 << 32, b"ip", None, self.back).to_bytes(4, "big")))

    def date(self, s: str) -> str | None:
        mark = next(c for c in s if not c.isdigit())
        a, b, c = (int(p) for p in s.split(mark))
        year_first = len(s.split(mark)[0]) == 4
        month_first = mark == "/" and not year_first and a <= 12
        try:
            day = dt.date(a, b, c) if year_first else dt.date(c, a, b) if month_first else dt.date(c, b, a)
        except ValueError:
            return None
        x = day.toordinal() - _DAY0
        if not 0 <= x < _DAYS:
            return None

        def on(x):
            return dt.date.fromordinal(_DAY0 + x)

        # day-first dates written with slashes stay recognisable: their day is over 12
        member = (lambda x: on(x).day > 12) if mark == "/" and not year_first and not month_first else None
        new = on(self.feistel.permute(x, _DAYS, b"date" + bytes([member is not None]), member, self.back))
        parts = ((f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}") if year_first
                 else (f"{new.month:02d}", f"{new.day:02d}", f"{new.year:04d}") if month_first
                 else (f"{new.day:02d}", f"{new.month:02d}", f"{new.year:04d}"))
        return mark.join(parts)

    def ssn(self, s: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        if not valid(s.replace("-", "")):
            return None
        return self._digits(s, lambda d: self._mixed(d, b"ssn", member=valid))

    def phone(self, s: str) -> str | None:
        if not 8 <= sum(c.isdigit() for c in s) <= 15:
            return None
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+1(?=\d{10}$)", s)
        keep = len(code.group()) if code else 0
        return s[:keep] + self._digits(s[keep:], lambda d: self._mixed(d, b"phone"))

    def number(self, s: str) -> str | None:
        def new(d: str) -> str:
            payload = self._mixed(d[:-1], b"card")
            return payload + _check_digit(payload)

        return self._digits(s, new) if luhn("".join(c for c in s if c.isdigit())) else None

    def secret(self, s: str) -> str | None:
        case = "0123456789abcdef" if s == s.lower() else "0123456789ABCDEF" if s == s.upper() else None
        if case:
            return self._mixed(s, b"hex", dict.fromkeys(case, case))
        return self._mixed(s, b"mixed-hex", _HEX)

    def _new(self, kind: str, value: str) -> str:
        """The pseudonym; empty for the shape without the rules, which is no value."""
        got = self.known.get((kind, value))
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            got = self._made(kind, value)
            # where nothing can change there is nothing to count
            got = self.known[kind, value] = got if got and got != value else ""
        return got

    def _made(self, kind: str, value: str) -> str | None:
        if value.isascii() or kind == "email":
            return getattr(self, kind)(value)
        zeros = {ord(c) - unicodedata.decimal(c) for c in value if c.isdecimal()}
        if len(zeros) != 1:
            return None
        zero = zeros.pop()
        new = getattr(self, kind)("".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value))
        return new and "".join(chr(zero + int(c)) if c in "0123456789" else c for c in new)

    def _value(self, text: str, m: re.Match) -> tuple[str, int, str] | None:
        """Kind, end and pseudonym of the value that begins with the match."""
        if m.lastgroup != "iban":
            new = self._new(m.lastgroup, m.group())
            return (m.lastgroup, m.end(), new) if new else None
        for end in _iban_ends(m.group()):
            if new := self._new("iban", m.group()[:end]):
                return "iban", m.start() + end, new
        for kind, pattern in _AFTER_IBAN.items():
            if (other := pattern.match(text, m.start())) and (new := self._new(kind, other.group())):
                return kind, other.end(), new
        return None

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind."""
        found: dict[str, int] = {}
        if not _WORTH.search(text):
            return text, found

        parts, done, at = [], 0, 0
        while m := _ANY.search(text, at):
            value = self._value(text, m)
            if value is None:
                at = m.start() + 1 if m.lastgroup == "iban" else m.end()
                continue
            kind, at, new = value
            found[kind] = found.get(kind, 0) + 1
            parts += text[done:m.start()], new
            done = at
        return "".join([*parts, text[done:]]), found


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", counts: bool = False,
                 back: bool = False) -> DataFrame:
    """``df`` with pseudonyms in its texts; ``counts`` adds one column per kind."""
    extra = KINDS if counts else ()
    fields = [f for f in df.schema.fields if f.name not in extra]
    names = [f.name for f in fields]
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in fields]
                          + [T.StructField(k, T.LongType()) for k in extra])
    rows = df.select(*(df[n].cast("string").alias(n) if n == text_col else df[n] for n in names))

    def run(batches):
        names_of = Pseudonyms(key, back)
        for b in batches:
            texts, found = [], []
            for t in b.column(names.index(text_col)).to_pylist():
                new, n = (None, {}) if t is None else names_of.replace(t)
                texts.append(new)
                found.append(n)
            columns = [pa.array(texts, pa.string()) if n == text_col else b.column(i) for i, n in enumerate(names)]
            columns += [pa.array([n.get(k, 0) for n in found], pa.int64()) for k in extra]
            yield pa.RecordBatch.from_arrays(columns, [*names, *extra])

    return map_batches(rows, run, schema)


def restore(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Undo :func:`pseudonymise` with its key."""
    return pseudonymise(df, key, text_col, back=True)
