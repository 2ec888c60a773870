"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Every kind of value has a format: a pattern, a check that the value is valid, and a numbering of all valid values from 0.  The number is
permuted within its domain (balanced Feistel network over a square that covers it, walked until the result lies inside), and
the result is written in the same format.  The permutation depends on the key and the kind only, so equal values stay equal in all
documents, and different values stay different.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from bisect import bisect_left
from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache
from heapq import merge
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame

from acrelane.llm.common import clear_names, col, map_texts

#: The session setting that holds the secret key; without it the key is the default, which everybody knows, so pseudonyms can be turned back.
KEY_SETTING = "spark.acrelane.pseudonymKey"
DEFAULT_KEY = "change me: a secret of the deployment"
ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def permute(number: int, domain: int, key: bytes, kind: str) -> int:
    """A keyed permutation of 0..domain-1."""
    if domain < 2:
        return number
    side = isqrt(domain - 1) + 1
    width = (side.bit_length() + 7) // 8 + 8
    tweak = f"{kind}:{domain}:".encode()
    while True:
        left, right = divmod(number, side)
        for turn in range(ROUNDS):
            mixed = hashlib.blake2b(tweak + turn.to_bytes(1, "big") + right.to_bytes(width, "big"), key=key, digest_size=min(64, width)).digest()
            left, right = right, (left + int.from_bytes(mixed, "big")) % side
        number = left * side + right
        if number < domain:  # values beyond the domain walk on along their cycle
            return number


def _mixed(values: list[int], radices: list[int]) -> int:
    n = 0
    for v, r in zip(values, radices, strict=True):
        n = n * r + v
    return n


def _unmixed(n: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        n, v = divmod(n, r)
        out.append(v)
    return out[::-1]


def _refill(template: str, digits: str) -> str:
    """template with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in template)


def luhn_ok(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not luhn_ok(digits) or len(set(digits)) == 1:
        return None
    n = len(digits)
    # the first digit is kept, the last is a check digit; all between are permuted
    body = digits[0] + str(permute(int(digits[1:-1]), 10 ** (n - 2), key, f"card{n}{digits[0]}")).zfill(n - 2)
    return _refill(text, body + next(c for c in "0123456789" if luhn_ok(body + c)))


def _phone(text: str, key: bytes) -> str | None:
    plus = text.startswith("+")
    digits = re.sub(r"\D", "", text)
    if plus and not digits.startswith("1"):
        if not 8 <= len(digits) <= 15:
            return None
        keep = digits[:2]  # country code
        return _refill(text, keep + str(permute(int(digits[2:]), 10 ** (len(digits) - 2), key, f"phone{len(digits)}{keep}")).zfill(len(digits) - 2))
    country, local = digits[:-10], digits[-10:]
    if len(local) != 10 or country not in ("", "1"):
        return None
    return _refill(text, country + str(permute(int(local), 10**10, key, "phone")).zfill(10))


def _address(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if any(x > 255 for x in parts):
        return None
    return ".".join(map(str, _unmixed(permute(_mixed(parts, [256] * 4), 256**4, key, "ip"), [256] * 4)))


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in re.split(r"[- ]", text))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    radices = [898, 99, 9999]
    a, g, s = _unmixed(permute(_mixed([area - 1 - (area > 666), group - 1, serial - 1], radices), prod(radices), key, "ssn"), radices)
    a += 1 + (a + 1 >= 666)
    return _refill(text, f"{a:03d}{g + 1:02d}{s + 1:04d}")


def _iban_sum(country: str, check: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + check)) % 97


def _iban(text: str, key: bytes) -> str | None:
    bare = re.sub(r"\s", "", text)
    country, check, rest = bare[:2], bare[2:4], bare[4:]
    if not 15 <= len(bare) <= 34 or _iban_sum(country, check, rest) != 1:
        return None
    radices = [10 if c in "0123456789" else 26 for c in rest]
    values = [int(c) if r == 10 else ord(c) - 65 for c, r in zip(rest, radices, strict=True)]
    shape = "".join("9" if r == 10 else "A" for r in radices)
    new = _unmixed(permute(_mixed(values, radices), prod(radices), key, f"iban{country}{shape}"), radices)
    rest = "".join(str(v) if r == 10 else chr(65 + v) for v, r in zip(new, radices, strict=True))
    out = iter(country + f"{98 - _iban_sum(country, '00', rest):02d}" + rest)
    return "".join(c if c.isspace() else next(out) for c in text)


def _same_shape(text: str, key: bytes, kind: str) -> str:
    """ASCII digits stay digits, letters stay letters of their case, all else stays."""
    radices = [10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1 for c in text]
    base = [48 if r == 10 else 97 if "a" <= c <= "z" else 65 for c, r in zip(text, radices, strict=True)]
    values = [ord(c) - b if r > 1 else 0 for c, b, r in zip(text, base, radices, strict=True)]
    shape = "".join(c if r == 1 else "9" if r == 10 else chr(b) for c, b, r in zip(text, base, radices, strict=True))
    new = _unmixed(permute(_mixed(values, radices), prod(radices), key, kind + shape), radices)
    return "".join(c if r == 1 else chr(b + v) for c, b, r, v in zip(text, base, radices, new, strict=True))


def _email(text: str, key: bytes) -> str | None:
    local, _, host = text.rpartition("@")
    return _same_shape(local, key, f"email@{host.lower()}:") + "@" + host


def _access_key(text: str, key: bytes) -> str | None:
    return text[:4] + _same_shape(text[4:], key, "access")


def _secret(text: str, key: bytes) -> str | None:
    if not (re.search(r"[0-9]", text) and re.search(r"[A-Fa-f]", text)):
        return None
    n = len(text)
    new = f"{permute(int(text, 16), 16**n, key, f'hex{n}'):0{n}x}"
    return new.upper() if text.upper() == text else new


def _day(y: int, m: int, d: int) -> date | None:
    try:
        day = date(y, m, d)
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


@lru_cache(maxsize=4)
def _days_like(day_digits: int, month_digits: int) -> list[int]:
    """The days, as ordinals, whose day and month have so many digits."""
    days = (FIRST_DAY + timedelta(i) for i in range((LAST_DAY - FIRST_DAY).days + 1))
    return [d.toordinal() for d in days if (len(str(d.day)), len(str(d.month))) == (day_digits, month_digits)]


def _moved(day: date, key: bytes) -> date:
    """Another day with as many digits in day and month, so that any way to write a date keeps its length, and the same for all ways."""
    digits = len(str(day.day)), len(str(day.month))
    days = _days_like(*digits)
    return date.fromordinal(days[permute(bisect_left(days, day.toordinal()), len(days), key, f"date{digits[0]}{digits[1]}")])


def _iso(text: str, key: bytes) -> str | None:
    y, m, d = (int(x) for x in re.split(r"[-/.]", text))
    day = _day(y, m, d)
    if day is None:
        return None
    new = _moved(day, key)
    return _refill(text, f"{new.year:04d}{new.month:02d}{new.day:02d}")


def _written_date(text: str, key: bytes) -> str | None:
    """Day, month, year; month first if the value is valid so and is parted by slashes."""
    parts = re.split(r"[-/.]", text)
    a, b, y = map(int, parts)
    sep = re.search(r"[-/.]", text)[0]
    month_first = sep == "/" and _day(y, a, b) is not None
    day = _day(y, a, b) if month_first else _day(y, b, a)
    if day is None:
        return None
    new = _moved(day, key)
    first, second = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{first:0{len(parts[0])}d}{sep}{second:0{len(parts[1])}d}{sep}{new.year:04d}"


#: Kind, pattern and pseudonym function, in the order in which they are tried at a position.  Fixed formats.
KINDS: list[tuple[str, str, Callable[[str, bytes], str | None]]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{16,64}|[0-9A-F]{16,64})(?![A-Za-z0-9])", _secret),
    ("secret", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", _access_key),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])(?!\.\d)", _card),
    ("ip", r"(?<![\w.-])(?:\d{1,3}\.){3}\d{1,3}(?![\w-])(?!\.\d)", _address),
    ("ssn", r"(?<![\w.+-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])(?!\.\d)", _ssn),
    ("date", r"(?<![\w.+-])\d{4}([-/.])\d{2}\2\d{2}(?!\d)(?!\.\d)", _iso),
    ("date", r"(?<![\w.+-])\d{1,2}([-/.])\d{1,2}\3\d{4}(?![\w-])(?!\.\d)", _written_date),
    ("phone", r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])(?!\.\d)", _phone),
    ("phone", r"(?<![\w.+-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])(?!\.\d)", _phone),
]
_ANY = re.compile("[0-9@]")
_PATTERNS = [(kind, re.compile(re.sub(r"\\[123]", r"\\1", pattern), re.A), fn) for kind, pattern, fn in KINDS]


@lru_cache(maxsize=1 << 16)
def pseudonym(at: int, value: str, key: bytes) -> str | None:
    return _PATTERNS[at][2](value, key)


def replace_all(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The whole text with every valid value replaced, and how many of each kind there were."""
    counts: dict[str, int] = {}
    if not _ANY.search(text):
        return text, counts
    spans: list[tuple[int, int, str]] = []  # in order, without overlap
    for at, (kind, pattern, _) in enumerate(_PATTERNS):
        new_spans, k = [], 0
        for found in pattern.finditer(text):
            start, end = found.span()
            while k < len(spans) and spans[k][1] <= start:
                k += 1
            if k < len(spans) and spans[k][0] < end:
                continue
            new = pseudonym(at, found[0], key)
            if new is not None:
                new_spans.append((start, end, new))
                counts[kind] = counts.get(kind, 0) + 1
        if new_spans:
            spans = list(merge(spans, new_spans))
    out, done = [], 0
    for start, end, new in spans:
        out += [text[done:start], new]
        done = end
    return "".join([*out, text[done:]]), counts


def pseudonymise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, text, n_replaced, kinds) with emails, IBANs, hexadecimal secrets and access keys, card numbers, IPv4 addresses, social security
    numbers, dates and phone numbers replaced by valid values of the same format.

    kinds is 'kind=count' in order of name, joined by commas ('' if none).  Values that fail their check (Luhn, IBAN sum,
    octets, calendar, ranges) are left as they are.  A null text stays null with 0; repeated rows give repeated rows; an empty table
    gives none; columns beside id and keep are not carried; a kept column with a result's name gets _in behind it.  The key is the session's
    KEY_SETTING unless one is given.
    """
    key = key or df.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a public key", stacklevel=2)
        key = DEFAULT_KEY
    secret = hashlib.blake2b(key.encode()).digest()
    names = clear_names([id_col, *keep], [text_col, "n_replaced", "kinds"])

    def fn(texts: list) -> dict:
        got = [(None, {}) if t is None else replace_all(t, secret) for t in texts]
        kinds = [",".join(f"{k}={v}" for k, v in sorted(c.items())) for _, c in got]
        return {"t": pa.array([t for t, _ in got], pa.string()), "n": pa.array([sum(c.values()) for _, c in got], pa.int32()), "kinds": pa.array(kinds, pa.string())}

    out = map_texts(df, [(n, col(c)) for n, c in zip(names, [id_col, *keep], strict=True)], col(text_col), fn, "t string, n_replaced int, kinds string")
    return out.toDF(*names, text_col, "n_replaced", "kinds")
