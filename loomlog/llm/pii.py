"""PII: format-preserving Feistel pseudonyms.

A value is found by a pattern, validated (check digits, octets, calendar, number plans), mapped to its place 0, 1,
2, ... among all valid values of its format, moved to another place by a keyed permutation of exactly that range,
and written in the same format again. So equal values stay equal in all documents, different values stay
different, the results are valid, and the key's holder can go back.

The permutation is a Feistel network over a x b, with cycle walking down to the range, conjugated with a step of
one: E^-1(E(x) + 1). That leaves no value where it was.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import map_in_arrow, text_or_empty

ROUNDS = 10
#: Used where the caller gives no key; a production run passes its own secret.
DEMO_KEY = b"loomlog demo key"


class Feistel:
    """Keyed permutation of range(n)."""

    def __init__(self, n: int, key: bytes, tweak: str) -> None:
        self.n, self.key, self.tweak = n, hashlib.sha256(key).digest(), tweak.encode()
        self.a = math.isqrt(n - 1) + 1 if n > 1 else 1
        self.b = -(-n // self.a)

    def _f(self, k: int, x: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        body = k.to_bytes(1, "big") + x.to_bytes((x.bit_length() + 7) // 8 + 1, "big") + self.tweak
        return int.from_bytes(hashlib.shake_256(self.key + body).digest(size), "big") % modulus

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * self._f(k, left, self.b)) % self.b
            else:
                left = (left + sign * self._f(k, right, self.a)) % self.a
        return left * self.b + right

    def encrypt(self, x: int) -> int:
        while True:
            x = self._once(x, False)
            if x < self.n:
                return x

    def decrypt(self, x: int) -> int:
        while True:
            x = self._once(x, True)
            if x < self.n:
                return x

    def move(self, x: int, back: bool = False) -> int:
        """A permutation without fixed points (for n > 1), and the way back."""
        return self.decrypt((self.encrypt(x) + (-1 if back else 1)) % self.n)


Mover = Callable[[int, int, str], int]  # place, number of places, format -> new place


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), shape)


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _card(s: str, move: Mover) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or luhn_digit(d[:-1]) != d[-1]:
        return None
    inner = len(d) - 2
    body = d[0] + str(move(int(d[1:-1]), 10**inner, f"card{len(d)}{d[0]}")).zfill(inner)
    return _refill(s, body + luhn_digit(body))


def _ipv4(s: str, move: Mover) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(str(b) for b in move(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, "ipv4").to_bytes(4, "big"))


def _nanp(s: str, move: Mover) -> str | None:
    d = _digits(s)
    head, d = d[:-10], d[-10:]
    if d[0] in "01" or d[3] in "01":
        return None
    place = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10_000 + int(d[6:])
    rest, line = divmod(move(place, 800 * 800 * 10_000, "nanp"), 10_000)
    area, office = divmod(rest, 800)
    return _refill(s, f"{head}{area + 200}{office + 200}{line:04d}")


def _e164(s: str, move: Mover) -> str | None:
    d = _digits(s)
    if not 9 <= len(d) <= 15 or d[0] == "0":
        return None
    if d[0] == "1":  # the same numbers as without the plus sign
        return _nanp(s, move) if len(d) == 11 else None
    keep = 2  # country codes have one to three digits; what follows the second is moved
    n = len(d) - keep
    return _refill(s, d[:keep] + str(move(int(d[keep:]), 10**n, f"e164-{d[:keep]}-{n}")).zfill(n))


def _ssn(s: str, move: Mover) -> str | None:
    area, group, serial = (int(x) for x in re.split("[- ]", s))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(move(place, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(rest, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}{s[3]}{group + 1:02d}{s[6]}{serial + 1:04d}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _iban(s: str, move: Mover) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = _mixed(flat[4:], move, f"iban{flat[:2]}")
    flat = f"{flat[:2]}{98 - _mod97(body + flat[:2] + '00'):02d}{body}"
    it = iter(flat)
    return re.sub(r"[^ ]", lambda _: next(it), s)


_RADIX = {"0": (10, "0123456789"), "a": (26, "abcdefghijklmnopqrstuvwxyz"), "A": (26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")}


def _mixed(s: str, move: Mover, tweak: str) -> str:
    """Moves the ASCII letters and digits of s, each within its class; other characters stay."""
    kinds = ["0" if c in _RADIX["0"][1] else "a" if c in _RADIX["a"][1] else "A" if c in _RADIX["A"][1] else c for c in s]
    place, n = 0, 1
    for c, k in zip(s, kinds, strict=True):
        if k in _RADIX:
            place, n = place * _RADIX[k][0] + _RADIX[k][1].index(c), n * _RADIX[k][0]
    if n == 1:
        return s
    place, out = move(place, n, f"{tweak}|{''.join(kinds)}"), []
    for c, k in zip(reversed(s), reversed(kinds), strict=True):
        if k in _RADIX:
            place, x = divmod(place, _RADIX[k][0])
            c = _RADIX[k][1][x]
        out.append(c)
    return "".join(reversed(out))


def _email(s: str, move: Mover) -> str | None:
    local, _, host = s.rpartition("@")
    return f"{_mixed(local, move, 'email')}@{host}"


FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


@functools.cache
def _late_days() -> tuple[list[int], dict[int, int]]:
    """Days after the 12th: month-first dates that can't be read day-first."""
    days = [d for d in range(FIRST_DAY, LAST_DAY + 1) if dt.date.fromordinal(d).day > 12]
    return days, {d: k for k, d in enumerate(days)}


def _day(y: int, m: int, d: int) -> int | None:
    try:
        day = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


def _iso_date(s: str, move: Mover) -> str | None:
    day = _day(int(s[:4]), int(s[5:7]), int(s[8:]))
    if day is None:
        return None
    new = dt.date.fromordinal(FIRST_DAY + move(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
    return f"{new.year}{s[4]}{new.month:02d}{s[7]}{new.day:02d}"


def _written_date(s: str, move: Mover) -> str | None:
    """Day first where that is a date, and as the same date in ISO's order; else month first, as a date that can't be read day first."""
    a, b, y = int(s[:2]), int(s[3:5]), int(s[6:])
    if (day := _day(y, b, a)) is not None:
        new = dt.date.fromordinal(FIRST_DAY + move(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
        return f"{new.day:02d}{s[2]}{new.month:02d}{s[5]}{new.year}"
    if (day := _day(y, a, b)) is not None:
        days, place = _late_days()
        new = dt.date.fromordinal(days[move(place[day], len(days), "month first")])
        return f"{new.month:02d}{s[2]}{new.day:02d}{s[5]}{new.year}"
    return None


#: Kind, pattern, and the function that validates and moves; tried in this order at each place of the text.
KINDS: tuple[tuple[str, str, Callable[[str, Mover], str | None]], ...] = (
    # begins where its run of characters does: long runs of dots or dashes would else be tried at each place
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _iban),
    ("ipv4", r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])", _ipv4),
    ("iso_date", r"[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}", _iso_date),
    ("date", r"[0-9]{2}([-/.])[0-9]{2}\1[0-9]{4}", _written_date),
    ("ssn", r"[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}", _ssn),
    ("card", r"[0-9]{13,19}|[0-9]{4}([- ])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([- ])[0-9]{6}\2[0-9]{5}", _card),
    ("phone", r"(?:\+?1[-. ]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}", _nanp),
    ("e164", r"\+[0-9](?:[-. ]?[0-9]){8,14}", _e164),
)


def _combined() -> re.Pattern:
    parts, groups = [], 0
    for name, pattern, _ in KINDS:
        shifted = re.sub(r"\\([1-9])", lambda m, g=groups: rf"\{int(m[1]) + g + 1}", pattern)
        parts.append(f"(?P<{name}>{shifted})")
        groups += 1 + re.compile(pattern).groups
    return re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(parts) + r")(?![A-Za-z0-9])")


_ANY, _HINT = _combined(), re.compile(r"[0-9@]")
_ONE = {name: re.compile(rf"(?<![A-Za-z0-9])(?:{pattern})(?![A-Za-z0-9])") for name, pattern, _ in KINDS}
#: Characters of an IBAN by country; of other countries the whole candidate is tried.
IBAN_CHARS = {c: int(n) for n, cs in {"15": "NO", "16": "BE", "18": "DK FI NL FO GL", "19": "SI MK", "20": "AT BA EE LT LU XK KZ", "21": "CH HR LI LV", "22": "BG DE GB IE ME RS", "23": "AE GI IL", "24": "AD CZ ES RO SE SK SA TN", "26": "IS TR", "25": "PT", "27": "FR GR IT MC SM", "28": "AL CY HU LB PL"}.items() for c in cs.split()}


def _end(kind: str, text: str, start: int, stop: int) -> int:
    """Where the candidate ends; an IBAN after its country's number of characters, if a word ends there."""
    if kind == "iban" and (n := IBAN_CHARS.get(text[start : start + 2])):
        for k in range(start, stop):
            n -= text[k] != " "
            if not n:
                return k + 1 if k + 1 == stop or not text[k + 1].isalnum() else stop
    return stop
_BY_KIND = {name: f for name, _, f in KINDS}


class Pseudonyms:
    """Replaces the values of one text after another with one key; remembers recent values."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        network = functools.lru_cache(4096)(lambda n, tweak: Feistel(n, key, tweak))
        move: Mover = lambda x, n, tweak: network(n, tweak).move(x, back)
        self.new = functools.lru_cache(65_536)(lambda kind, value: _BY_KIND[kind](value, move))

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The new text, and kind, start and end of each value in the old one."""
        if not _HINT.search(text):
            return text, []
        out, spans, done = [], [], 0
        at = 0
        while m := _ANY.search(text, at):
            at = m.start() + 1
            for kind, one in _ONE.items():
                if not (found := one.match(text, m.start())):
                    continue
                stop = _end(kind, text, m.start(), found.end())
                new = self.new(kind, text[m.start() : stop])
                if new is not None:
                    out += [text[done : m.start()], new]
                    done = at = stop
                    spans.append((kind, m.start(), stop))
                    break
        return ("".join([*out, text[done:]]), spans) if spans else (text, spans)


def _replacer(key: bytes, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(1).to_pylist():
                new, found = (None, []) if text is None else names.replace(text)
                texts.append(new)
                spans.append([{"kind": k, "start": s, "stop": e} for k, s, e in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "pii"])

    return run


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, back: bool = False) -> DataFrame:
    """(doc_id, text, pii): each row's text with its validated values replaced, and kind, start, stop of the old values.

    ``back`` undoes it with the same key. The host of a mail address stays, and so do the country codes of numbers.
    Values are equal by what they say, not by how they are spaced; a month-first date is linked with its like alone.
    A null text stays null, an empty one empty; texts of any length are searched whole; texts without such values are
    unchanged; repeated rows get a row each; other columns, whatever they are called, are not looked at; an empty
    table gives an empty one. No shuffle.
    """
    return map_in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _replacer(key, back), "doc_id bigint, text string, pii array<struct<kind:string,start:int,stop:int>>")


def with_counts(found: DataFrame) -> DataFrame:
    """Adds n_pii and the number of values of each kind."""
    count = lambda name: F.size(F.filter("pii", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", F.size("pii").cast("long").alias("n_pii"), *[count(name) for name, _, _ in KINDS], F.concat_ws(",", F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"]))).alias("spans"), text_or_empty().alias("text"))
