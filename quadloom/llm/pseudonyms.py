"""Operator 6: format-preserving pseudonyms for personal numbers and dates.

What looks like a number or date of a person is validated (check sums, number plans, the calendar) and
replaced by the image of a keyed permutation of all values of its format, a Feistel network. The image
is valid itself, and equal values have equal images in all documents, so links stay. Numbers of base 36
and 16 count too: the local part of a mail address and long hexadecimal secrets.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import lean, prepare, table

#: Setting of the session that holds the key; whoever has the key can undo the pseudonyms.
KEY_SETTING = "spark.quadloom.pseudonyms.key"
ROUNDS = 8
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # to 2099-12-31


def _round(key: bytes, tweak: bytes, i: int, half: int, mask: int) -> int:
    d = hashlib.blake2b(half.to_bytes(32, "little") + bytes([i]) + tweak, key=key, digest_size=32).digest()
    return int.from_bytes(d, "little") & mask


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """The keyed permutation of 0..size-1: a balanced Feistel network, walked until within the range."""
    if size < 2:
        return value
    w = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << w) - 1
    while True:
        a, b = value >> w, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (b ^ _round(key, tweak, i, a, mask), a) if back else (b, a ^ _round(key, tweak, i, b, mask))
        value = a << w | b
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that makes digits + it pass the Luhn test."""
    total = sum(sum(divmod(2 * int(x), 10)) if i % 2 == 0 else int(x) for i, x in enumerate(reversed(digits)))
    return -total % 10


def _refill(shape: str, digits: str, kind=str.isdigit) -> str:
    """`shape` with its digits replaced in order; everything else stays."""
    it = iter(digits)
    return "".join(next(it) if kind(c) else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    n = len(d) - 2  # the first digit, which tells the network, and the check digit are kept apart
    body = str(permute(int(d[1:-1]), 10**n, key, b"card" + d[0].encode() + bytes([n]))).zfill(n)
    return _refill(s, d[0] + body + str(luhn(d[0] + body)))


_IBAN_LENGTH = {"AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27}


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    country, check, body = flat[:2], flat[2:4], flat[4:]
    if _IBAN_LENGTH.get(country) != len(flat) or int(check) != _iban_check(country, body):
        return None
    radix = [10 if c.isdigit() else 26 for c in body]
    value = size = 0
    size = 1
    for c, r in zip(body, radix, strict=True):
        value, size = value * r + (int(c) if r == 10 else ord(c) - 65), size * r
    value, out = permute(value, size, key, b"iban" + country.encode() + bytes(radix)), []
    for r in reversed(radix):
        value, x = divmod(value, r)
        out.append(str(x) if r == 10 else chr(65 + x))
    body = "".join(reversed(out))
    return _refill(s, country + f"{_iban_check(country, body):02d}" + body, str.isalnum)


def _ip(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    v = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not _ssn_ok(d):
        return None
    while True:
        d = str(permute(int(d), 10**9, key, b"ssn")).zfill(9)
        if _ssn_ok(d):
            return _refill(s, d)


def _phone_ok(d: str) -> bool:
    return d[0] in "23456789" and d[3] in "23456789"


def _phone(s: str, key: bytes) -> str | None:
    """A number of the North American plan, or an international one that begins with +."""
    d = _digits(s)
    if len(d) in (10, 11) and (len(d) == 10 or d[0] == "1") and _phone_ok(d[-10:]):
        lead, d = d[:-10], d[-10:]
        while True:
            d = str(permute(int(d), 10**10, key, b"phone")).zfill(10)
            if _phone_ok(d):
                return _refill(s, lead + d)
    if s[0] == "+" and 8 <= len(d) <= 15:
        n = len(d) - 2
        return _refill(s, d[:2] + str(permute(int(d[2:]), 10**n, key, b"phone" + d[:2].encode() + bytes([n]))).zfill(n))
    return None


def _date(s: str, key: bytes) -> str | None:
    """ISO order, or day and month first; with slashes the month comes first unless that is no date."""
    a, b, c = map(int, re.split(r"[-./]", s))
    sep = s[4] if s[:4].isdigit() else next(x for x in s if not x.isdigit())
    orders = ["ymd"] if s[:4].isdigit() else ["mdy", "dmy"] if sep == "/" else ["dmy", "mdy"]
    for order in orders:
        part = dict(zip(order, (a, b, c), strict=True))
        try:
            day = datetime.date(part["y"], part["m"], part["d"]).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        new = datetime.date.fromordinal(permute(day, _DAYS, key, b"date") + _FIRST_DAY)
        width = {"y": 4, "m": 2, "d": 2}
        return sep.join(str({"y": new.year, "m": new.month, "d": new.day}[k]).zfill(width[k]) for k in order)
    return None


def _mail(s: str, key: bytes) -> str | None:
    local, _, domain = s.rpartition("@")
    radix = [10 if "0" <= c <= "9" else 26 for c in local if c.isascii() and c.isalnum()]
    value, size = 0, 1
    for c, r in zip((c for c in local.lower() if c.isascii() and c.isalnum()), radix, strict=True):
        value, size = value * r + (int(c) if r == 10 else ord(c) - 97), size * r
    value, out = permute(value, size, key, b"mail" + bytes(radix)), []
    for r in reversed(radix):
        value, x = divmod(value, r)
        out.append(str(x) if r == 10 else chr(97 + x))
    return _refill(local, "".join(reversed(out)), lambda c: c.isascii() and c.isalnum()) + "@" + domain


def _hex(s: str, key: bytes) -> str | None:
    if not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
        return None
    new = format(permute(int(s, 16), 16 ** len(s), key, b"hex" + bytes([len(s) % 256])), "x").zfill(len(s))
    return new.upper() if s.isupper() else new


_KINDS = {"mail": _mail, "iban": _iban, "hex": _hex, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}
_PARTS = {
    "mail": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "hex": r"[0-9a-f]{32,64}|[0-9A-F]{32,64}",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}-[0-9]{2}-[0-9]{4}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9](?:[ .()-]{0,2}[0-9]){7,13}",
}
_PATTERN = re.compile(
    rf"(?P<mail>{_PARTS['mail']})|(?<![A-Za-z0-9])(?:" + "|".join(f"(?P<{k}>{p})" for k, p in _PARTS.items() if k != "mail") + r")(?![A-Za-z0-9])"
)
_LETTER = re.compile("[A-Za-z0-9]")
#: No value but a mail address is longer.
_LONGEST = 64
#: A text without any of these cannot hold a value.
_HINT = r"[0-9]|@"


@functools.lru_cache(65_536)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of one value, or None if it isn't valid and so stays as it is."""
    return _KINDS[kind](value, key)


#: A reading that fails its check may hold a value that ends sooner, or one that begins after its first group.
_GROUP = re.compile(r"[0-9A-Za-z]+")
_WHOLE = {k: re.compile(p) for k, p in _PARTS.items()}


def _readings(text: str, m: re.Match) -> Iterator[tuple[str, int]]:
    """Kind and end of all readings that begin where `m` does: its own, then those of each kind that end sooner or later."""
    begin = m.start()
    yield m.lastgroup, m.end()
    ends = [g.end() for g in _GROUP.finditer(text, begin, min(len(text), begin + _LONGEST))]
    for kind, whole in _WHOLE.items():
        if kind != "mail":
            for end in reversed(ends):
                if (kind, end) != (m.lastgroup, m.end()) and (end == len(text) or not _LETTER.match(text[end])) and whole.fullmatch(text, begin, end):
                    yield kind, end


def pseudonymise(text: str, key: bytes) -> tuple[str, int]:
    """The text with all valid values replaced, and how many they are."""
    n, at, done, out = 0, 0, 0, []
    while m := _PATTERN.search(text, at):
        begin = m.start()
        for kind, end in _readings(text, m):
            new = pseudonym(kind, text[begin:end], key)
            if new is not None:
                out += [text[done:begin], new]
                n, at, done = n + 1, end, end
                break
        else:
            # on after the first group, not after the whole of it
            group = _GROUP.search(text, begin, m.end())
            at = group.end() if group else m.end()
    return "".join([*out, text[done:]]), n


def _secret(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def _rewriter(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            counts = [0] * len(column)
            at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, _HINT), False)).to_pylist()
            out = column
            if at:
                texts = column.to_pylist()
                for i in at:
                    texts[i], counts[i] = pseudonymise(texts[i], key)
                out = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out, pa.array(counts, pa.int64())], names=["doc_id", "text", "n_values"])

    return run


def pseudonymise_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_values): every document with its values replaced, and their number.

    The key is a secret: the one given, or that of the session's setting KEY_SETTING, or else one drawn for this call, whose
    pseudonyms are linked within its result and to nothing else, as nobody knows the key.

    A null text stays null and an empty one empty, with 0 values; null ids stay null; repeated rows give
    repeated rows with the same pseudonyms; other columns are ignored; an empty table gives no rows. Texts
    are scanned whole. A number that fails its check (Luhn, mod 97, number plan, calendar) is no personal
    value and stays.
    """
    prepare(docs.sparkSession)
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_rewriter(_secret(key))), "doc_id long, text string, n_values long")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise_documents(table(spark, sf_dir, "documents"))
