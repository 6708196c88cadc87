"""Format-preserving pseudonyms for personal data.

Validated values (card numbers by the Luhn rule, IPv4 addresses, telephone numbers, IBANs by mod 97, calendar dates, mail addresses)
are replaced by values of the same format from a keyed permutation of that format's values, a Feistel network with cycle walking.
The permutation depends only on the key and the format, so equal values get equal pseudonyms in every document, different values
different ones, and whoever holds the key can invert it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Dates permute within 200 years, of which one such span begins here.
SPAN_YEARS, SPAN_FROM = 200, 1900


def permute(value: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of 0..size-1: balanced Feistel on the next even number of bits, walked until the value is in range."""
    if size < 2:
        return value
    half = max(1, (((size - 1).bit_length()) + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def part(i: int, x: int) -> int:
        out = b""
        while len(out) < width:
            out += hashlib.blake2b(x.to_bytes(width, "big") + bytes([i, len(out) // 64]), key=key, person=b"feistel", salt=hashlib.blake2b(tweak, digest_size=16).digest()).digest()
        return int.from_bytes(out[:width], "big") & mask

    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ part(i, left), left
            else:
                left, right = right, left ^ part(i, right)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows `digits`."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def in_format(text: str, characters: str) -> str:
    """Puts `characters` in place of the letters and digits of text; other characters of text stay."""
    it = iter(characters)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in text)


def mixed_radix(text: str, key: bytes, tweak: bytes, inverse: bool = False) -> str:
    """Permutes the strings that have digits, lower-case and upper-case letters in the same places."""
    sets = [DIGITS if c in DIGITS else LETTERS if c in LETTERS else LETTERS.upper() for c in text]
    value, size = 0, 1
    for c, s in zip(text, sets, strict=True):
        value, size = value * len(s) + s.index(c), size * len(s)
    shape = "".join("0" if s is DIGITS else s[0] for s in sets)
    value = permute(value, size, key, tweak + shape.encode(), inverse)
    out = []
    for s in reversed(sets):
        value, at = divmod(value, len(s))
        out.append(s[at])
    return "".join(reversed(out))


def card(m: re.Match, key: bytes, inverse: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = mixed_radix(digits[:-1], key, b"card", inverse)
    return in_format(m[0], body + luhn_digit(body))


def ip(m: re.Match, key: bytes, inverse: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip", inverse)
    return ".".join(map(str, value.to_bytes(4, "big")))


def phone(m: re.Match, key: bytes, inverse: bool) -> str | None:
    """Permutes the digits after the country code, or all but a leading 0."""
    plus = re.match(r"\+\d{1,3}(?=[ (.-])|\+\d{2}|0|", m[0])[0]
    rest = m[0][len(plus) :]
    digits = re.sub(r"\D", "", rest)
    if not 6 <= len(digits) <= 14:
        return None
    return plus + in_format(rest, mixed_radix(digits, key, b"phone" + plus.encode(), inverse))


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def iban(m: re.Match, key: bytes, inverse: bool) -> str | None:
    plain = m[0].replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    account = mixed_radix(plain[4:], key, b"iban" + plain[:2].encode(), inverse)
    return in_format(m[0], plain[:2] + iban_check(plain[:2], account) + account)


def day(m: re.Match, key: bytes, inverse: bool) -> str | None:
    """Year first (2020-05-31) or last (31.05.2020; with / both orders are tried, day first)."""
    x, y, z = re.split(r"[-/.]", m[0])
    orders = ("ymd",) if len(x) == 4 else ("dmy", "mdy")
    for order in orders:
        parts = dict(zip(order, (x, y, z), strict=True))
        try:
            ordinal = date(int(parts["y"]), int(parts["m"]), int(parts["d"])).toordinal()
        except ValueError:
            continue
        since = SPAN_FROM + (int(parts["y"]) - SPAN_FROM) // SPAN_YEARS * SPAN_YEARS
        low, high = date(max(since, 1), 1, 1).toordinal(), date(min(since + SPAN_YEARS - 1, 9999), 12, 31).toordinal()
        # Month and day are told apart in the same way in what comes out: the permutation walks until it is.
        while True:
            ordinal = low + permute(ordinal - low, high - low + 1, key, b"date" + order.encode(), inverse)
            new = date.fromordinal(ordinal)
            if order != "mdy" or new.day > 12:
                break
        sep = m[0][len(x)]
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sep.join(values[c] for c in order)
    return None


def mail(m: re.Match, key: bytes, inverse: bool) -> str | None:
    """Permutes the local part; the domain's last two labels stay, those before are permuted."""
    local, _, domain = m[0].rpartition("@")
    labels = domain.split(".")
    head, tail = ".".join(labels[:-2]), ".".join(labels[-2:])
    both = re.sub(r"[^A-Za-z0-9]", "", local + head)
    made = in_format(f"{local}@{head}", mixed_radix(both, key, b"mail" + tail.lower().encode(), inverse))
    return made + ("." if head else "") + tail


#: Kinds in order of precedence where matches begin at the same place: expression and pseudonym function.
KINDS: dict[str, tuple[str, Callable]] = {
    "mail": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])", mail),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    "ip": (r"(?<![0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9]|\.[0-9])", ip),
    "date": (r"(?<![0-9./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![0-9]|[./-][0-9])", day),
    "card": (r"(?<![0-9A-Za-z])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])", card),
    "phone": (r"(?<![0-9A-Za-z+])\+\d(?:[ .-]?\(?\d{1,4}\)?){2,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\(\d{3}\) ?\d{3}-\d{4}(?![0-9])|(?<![0-9A-Za-z+-])\d{3}-\d{3}-\d{4}(?![0-9-])", phone),
}
EACH = [(k, re.compile(x), f) for k, (x, f) in KINDS.items()]
#: Kinds whose expression may take in what follows the value (a card's code or expiry): shorter ends between groups are tried too.
GROUPED = frozenset(("card", "iban"))
#: Where values can begin: at a run of digits with or without a sign before it, at a country code with check digits, or a mail address.
NUMBER, COUNTRY, MAIL = re.compile(r"[+(0-9][0-9]*"), re.compile(r"[A-Z]{2}[0-9]{2}"), re.compile(KINDS["mail"][0])


def beginnings(text: str) -> list[int]:
    starts = [m.start() for m in NUMBER.finditer(text)]
    if not starts and "@" not in text:
        return starts
    starts += [i + 1 for i in starts if text[i] in "+("] + [m.start() for m in COUNTRY.finditer(text)]
    if "@" in text:
        starts += [m.start() for m in MAIL.finditer(text)]
    return sorted(set(starts))


def ends(kind: str, m: re.Match) -> Iterator[int]:
    """Where the value of a match may end, the longest first."""
    yield m.end()
    if kind in GROUPED:
        for end in range(m.end() - 1, m.start(), -1):
            if m.string[end] in " -" and m.re.fullmatch(m.string, m.start(), end):
                yield end


def pseudonymise(text: str, key: bytes, inverse: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The new text and its replacements: kind, start and end in the old text, new value."""
    out, spans, at = [], [], 0
    new = _cached(key, inverse)
    for start in beginnings(text):
        if start < at:
            continue
        found = ((kind, end) for kind, regex, _ in EACH if (k := regex.match(text, start)) for end in ends(kind, k))
        for kind, end in found:  # the first kind that matches here and is valid
            if (value := new(kind, text[start:end])) is not None:
                out += [text[at:start], value]
                spans.append((kind, start, end, value))
                at = end
                break
    return "".join([*out, text[at:]]), spans


@lru_cache(4)
def _cached(key: bytes, inverse: bool):
    by_kind = {k: (r, f) for k, r, f in EACH}

    @lru_cache(100_000)
    def new(kind: str, value: str) -> str | None:
        regex, f = by_kind[kind]
        return f(regex.match(value), key, inverse)

    return new


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))


def pseudonyms(df: DataFrame, key: bytes, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """Replaces text_col by the pseudonymised text and adds pii_spans (kind, start and end in the old text in code points, new value).

    key is secret: whoever has it can undo the replacement. Null texts stay null with null spans, texts without personal data are unchanged with no spans. inverse undoes the replacement
    where the new values are found and read as the same kind. A column pii_spans is replaced. Rows stay one to one.
    """
    keep = [c for c in df.columns if c.lower() != "pii_spans"]
    at = keep.index(text_col)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("pii_spans", SPANS)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(None, None) if x is None else pseudonymise(x, key, inverse) for x in b.column(at).to_pylist()]
            spans = [None if s is None else [dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in s] for _, s in pairs]
            columns = list(b.columns)
            columns[at] = pa.array([t for t, _ in pairs], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, arrow)], names=[*b.schema.names, "pii_spans"])

    return df.select(*[F.col(c) for c in keep]).mapInArrow(work, schema)
