"""Format-preserving pseudonyms for personal data: keyed Feistel permutations within each value's format."""

from __future__ import annotations

import datetime as dt
import logging
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from ipaddress import IPv6Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import strings

ROUNDS = 10
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date", "secret")
#: The Spark setting that holds the key.
SETTING = "spark.gleaner.pii.key"


def feistel(value: int, left: int, right: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 .. left * right - 1, alternately adding a keyed function of one half to the other."""
    a, b = divmod(value, right)
    for i in range(ROUNDS):
        odd = i % 2
        seen = b if odd == 0 else a
        digest = blake2b(b"%d|%d|%b" % (i, seen, tweak), key=key, digest_size=64).digest()
        f = int.from_bytes(digest, "big")
        if odd == 0:
            a = (a + f) % left
        else:
            b = (b + f) % right
    return a * right + b


def permuted(value: int, size: int, key: bytes, tweak: bytes, valid: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the valid numbers below ``size``: the walk goes on until it meets a valid one again."""
    left = max(1, isqrt(size))
    right = -(-size // left)
    while True:
        value = feistel(value, left, right, key, tweak)
        if value < size and valid(value):
            return value


def luhn_digit(payload: str) -> str:
    """The check digit that follows the payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in shape)


def bare(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def card(text: str, key: bytes) -> str | None:
    """13 to 19 digits with a right check digit: all but the first are permuted, and the check digit follows."""
    d = bare(text)
    if not 13 <= len(d) <= 19 or d[0] == "0" or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = d[1:-1]
    new = d[0] + str(permuted(int(body), 10 ** len(body), key, b"card" + d[0].encode())).zfill(len(body))
    return refill(text, new + luhn_digit(new))


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return str(98 - int(number) % 97).zfill(2)


def iban(text: str, key: bytes) -> str | None:
    """Country and check digits that fit: the account's digits are permuted, its letters stay, the check digits follow."""
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34 or iban_check(s[:2], s[4:]) != s[2:4]:
        return None
    d = bare(s[4:])
    new = refill(s[4:], str(permuted(int(d), 10 ** len(d), key, b"iban" + s[:2].encode())).zfill(len(d))) if d else s[4:]
    flat = iter(s[:2] + iban_check(s[:2], new) + new)
    return "".join(c if c == " " else next(flat) for c in text)


def ssn_valid(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def ssn(text: str, key: bytes) -> str | None:
    """A social security number that can be issued becomes another that can."""
    d = bare(text)
    if not ssn_valid(int(d)):
        return None
    return refill(text, str(permuted(int(d), 10**9, key, b"ssn", ssn_valid)).zfill(9))


def phone(text: str, key: bytes) -> str | None:
    """8 to 15 digits after ``+``, or 10 without: the country's digit or digits before the first separator stay."""
    d = bare(text)
    if text.startswith("+"):
        if not 8 <= len(d) <= 15 or d[0] == "0":
            return None
        head = len(bare(re.match(r"\+\d{1,3}(?=\D)|\+\d", text)[0]))
    elif len(d) == 10:
        head = 0
    else:
        return None
    body = d[head:]
    return refill(text, d[:head] + str(permuted(int(body), 10 ** len(body), key, b"phone" + d[:head].encode())).zfill(len(body)))


def ip(text: str, key: bytes) -> str | None:
    """Four numbers up to 255 without leading zeros become four others; an IPv6 address another one, written as short as it was."""
    if ":" in text:
        try:
            address = IPv6Address(text)
        except ValueError:
            return None
        if address.is_loopback or address.is_unspecified or sum(map(bool, text.split(":"))) < 3:
            return None
        new = IPv6Address(permuted(int(address), 1 << 128, key, b"ip6"))
        new = new.exploded if len(text) == 39 else new.compressed
        return new.upper() if text.isupper() else new
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permuted(sum(int(p) << (24 - 8 * i) for i, p in enumerate(parts)), 1 << 32, key, b"ip")
    return ".".join(str(n >> (24 - 8 * i) & 255) for i in range(4))


FIRST, LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def date(text: str, key: bytes) -> str | None:
    """A calendar date from 1900 to 2099 becomes another in the same order of parts.

    Year first, else day first, else (where only that is a date) month first; of the last, dates that could be read with
    the day first are left out of the permutation, so that all results stay apart.
    """
    a, b, c = (int(x) for x in re.split(r"\D", text))
    sep = re.search(r"\D", text)[0]
    order, day = "", None
    for name, (y, m, d) in (("ymd", (a, b, c)),) if a > 31 else (("dmy", (c, b, a)), ("mdy", (c, a, b))):
        try:
            order, day = name, dt.date(y, m, d)
            break
        except ValueError:
            continue
    if day is None or not FIRST <= day <= LAST:
        return None
    valid = (lambda n: (FIRST + dt.timedelta(n)).day > 12) if order == "mdy" else (lambda _: True)
    new = FIRST + dt.timedelta(permuted((day - FIRST).days, (LAST - FIRST).days + 1, key, b"date" + order.encode(), valid))
    parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return sep.join(parts[p] for p in order)


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK = 48


def within(text: str, key: bytes, tweak: bytes) -> str | None:
    """Letters and digits permuted within their kinds, other characters in their places; None where there is none.

    A text of hexadecimal digits remains one. Longer texts are permuted in blocks of 48 characters.
    """
    seen = {c for c in text if c in DIGITS or c in LOWER or c in UPPER}
    if not seen:
        return None
    kinds = (DIGITS, LOWER, UPPER)
    for letters in ("abcdef", "ABCDEF"):
        if len(text) >= 16 and seen <= set(DIGITS + letters) and seen & set(letters):
            kinds = (DIGITS + letters,)
    out = []
    for low in range(0, len(text), BLOCK):
        part = text[low : low + BLOCK]
        of = [next((k for k in kinds if c in k), "") for c in part]
        n, size = 0, 1
        for c, k in zip(part, of):
            if k:
                n, size = n * len(k) + k.index(c), size * len(k)
        form = "".join(k[:1] or c for c, k in zip(part, of)).encode()
        n, made = permuted(n, size, key, b"%b%d|%b" % (tweak, low, form)), []
        for c, k in zip(reversed(part), reversed(of)):
            if k:
                n, at = divmod(n, len(k))
                c = k[at]
            made.append(c)
        out.append("".join(reversed(made)))
    return "".join(out)


def email(text: str, key: bytes) -> str | None:
    """The part before the @, and every label of the domain but the last, each permuted within its format: equal labels stay equal.

    Addresses that differ in upper and lower case alone are one: their pseudonyms too differ in that alone.
    """
    local, domain = text.split("@")
    *labels, last = domain.split(".")
    new = within(local.lower(), key, b"email")
    new = new and "".join(n.upper() if c.isupper() else n for n, c in zip(new, local))
    return new and ".".join([f"{new}@{within(labels[0].lower(), key, b'domain')}", *(within(x.lower(), key, b"domain") or x for x in labels[1:]), last])


# Words that name a secret before : or =, and beginnings of well-known tokens.
NAMES = ("token", "secret", "passwor", "passwd", "passphrase", "pwd", "api_key", "apikey", "api-key", "access_key", "access-key", "private_key", "auth_key")
STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "rk_live_", "AIza", "eyJ", "-----BEGIN")
SECRET = re.compile(
    r"(?P<block>-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)(?P<body>[^-]{1,20000})(?=-----END)"
    rf"|(?P<name>(?i:(?:{'|'.join(NAMES)})[A-Za-z0-9_-]{{0,24}}[\"']?\s{{0,8}}[:=]\s{{0,8}}))(?:\"(?P<a>[^\"\s]{{6,512}})\"|'(?P<b>[^'\s]{{6,512}})'|(?P<c>[A-Za-z0-9_./+=~!@#$%^&*-]{{8,512}}))"
    rf"|(?<![A-Za-z0-9])(?P<start>{'|'.join(map(re.escape, STARTS[:-1]))})(?P<rest>[A-Za-z0-9_.-]{{16,2048}})"
)
TELLS = tuple(x.lower() for x in (*NAMES, *STARTS))


def secrets(text: str, key: bytes) -> tuple[str, int]:
    """The text with keys, tokens and passwords permuted within their formats, and how many there were.

    What follows a telling name and : or = counts if it is quoted, or bare with both letters and digits; so do
    well-known beginnings with a long rest, and the bodies of private keys.
    """
    low, n = text.lower(), 0
    if not any(x in low for x in TELLS):
        return text, 0

    def put(m: re.Match) -> str:
        nonlocal n
        kind = next(k for k in ("body", "a", "b", "c", "rest") if m[k])
        value = m[kind]
        if kind in ("c", "rest") and (value.isalpha() or not any(c.isalpha() for c in value)):
            return m[0]
        new = within(value, key, b"secret")
        if new is None:
            return m[0]
        n += 1
        at, end = m.start(kind) - m.start(), m.end(kind) - m.start()
        return m[0][:at] + new + m[0][end:]

    return SECRET.sub(put, text), n


EMAIL = r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-]))"
NUMBERS = (
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?:(?![\w/-])|(?=T\d{2}:)))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)|(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![\w:]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-])|(?<![\w.])\+\d{8,15}(?!\w))"
)
BOTH, ALONE = re.compile(f"{EMAIL}|{NUMBERS}", re.ASCII), re.compile(NUMBERS, re.ASCII)
ANY, VALUES = re.compile(r"[0-9@]"), {"email": email, "iban": iban, "card": card, "ssn": ssn, "phone": phone, "ip": ip, "date": date}
PARTED = re.compile(r"[ -]")


def value(kind: str, text: str, key: bytes) -> tuple[str | None, int]:
    """The pseudonym of a match and how much of it that covers; or None, and where the search goes on.

    What follows a card or an IBAN after a separator can look like a part of it (a security code, an expiry, a word): if
    the whole fails its check, shorter ones that end at a separator are tried. The search goes on after the first group.
    """
    new = VALUES[kind](text, key)
    if new is not None:
        return new, len(text)
    parts = [m.start() for m in PARTED.finditer(text)] if kind in ("card", "iban") else []
    for end in reversed(parts):
        new = VALUES[kind](text[:end], key)
        if new is not None:
            return new, end
    return None, parts[0] + 1 if parts else len(text)


def pseudonymised(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many there were of each kind."""
    found = dict.fromkeys(KINDS, 0)
    text, found["secret"] = secrets(text, key)
    if not ANY.search(text):
        return text, found
    pattern, out, at, done = BOTH if "@" in text else ALONE, [], 0, 0
    while m := pattern.search(text, at):
        new, covered = value(m.lastgroup, m[0], key)
        at = m.start() + covered
        if new is not None:
            found[m.lastgroup] += 1
            out += [text[done : m.start()], new]
            done = at
    return "".join([*out, text[done:]]), found


LOGGER = logging.getLogger(__name__)


def session_key(spark: SparkSession, default: bytes | None = None) -> bytes:
    """The key that the session's setting ``spark.gleaner.pii.key`` holds; without one the default, with a warning, and ValueError if there is none."""
    given = spark.conf.get(SETTING, None)
    if given:
        return given.encode()
    if default is None:
        raise ValueError(f"no key: set {SETTING}")
    LOGGER.warning("%s is not set: pseudonyms are made with a known key, and anyone can undo them", SETTING)
    return default


def pseudonymise(docs: DataFrame, key: bytes, keep: bool = False) -> DataFrame:
    """Documents with personal numbers, dates and addresses replaced by pseudonyms: doc_id, text, a count for each kind.

    Values are e-mail addresses, and validated numbers: IBANs and cards with right check digits, social security numbers
    that can be issued, phone numbers, IP addresses and calendar dates from 1900 to 2099; and secrets: tokens, keys and
    passwords. A value becomes another valid one of its own format, by a permutation that the secret ``key`` selects:
    equal values stay equal in all documents, different ones different, and separators stay in place. Numbers that don't
    pass their check are left alone. Who has the key can undo it: there is no default.

    ``keep`` returns the table's own columns instead, text replaced, in their order. A null text stays null, an empty one
    empty, and texts of any length are read whole. A null doc_id is returned as null. Repeated rows are returned as often
    as they come. An empty table gives none. Other columns never matter.
    """
    if not key:
        raise ValueError("pseudonyms need a key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            done = [pseudonymised(t, key) for t in strings(b.column(at))]
            texts = pa.array([d[0] if ok else None for d, ok in zip(done, b.column(at).is_valid().to_pylist())], pa.string())
            if keep:
                yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)
            else:
                counts = [pa.array([d[1][k] for d in done], pa.int32()) for k in KINDS]
                yield pa.record_batch([b.column(0), texts, *counts], names=["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    if keep:
        docs = docs.withColumn("text", F.col("text").cast("string"))
        return docs.mapInArrow(run, docs.schema)
    schema = "doc_id long, text string, " + ", ".join(f"n_{k} int" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
