"""Operator 2: personal data replaced by format-preserving Feistel pseudonyms.

A value is found by its form, validated (card numbers by Luhn, IBANs by mod 97, addresses by octet
range, dates by the calendar), mapped to an integer within the values of its format, permuted by a
keyed Feistel network with cycle walking, and written back in the same format: digits stay digits,
separators and length stay, a valid card, IBAN or date stays valid. Equal values get equal
pseudonyms in every document and distinct values of a format distinct ones, so links survive.

Kinds: email, ip, card, iban, phone, ssn, date, secret. Numbers that don't validate stay as they are.

Addresses are found from their @ backward, so that a run of letters of any length is read once. Where two values
overlap the one that begins first counts, of two that begin together the first of KINDS' patterns.

Defined results. A null text stays null and has no counts; an empty one is unchanged. Texts of any length
are read whole, in time that grows with their length. Each row is rewritten by itself, so repeated rows stay equal;
a null doc_id is carried. An empty table gives no row. Other columns are untouched, whatever their names.
"""

from __future__ import annotations

import calendar
import datetime
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.arrays import column, fresh, pieces

#: Replace it: whoever has the key can invert the pseudonyms.
KEY = b"bitloom example key"
ROUNDS = 10
KINDS = ("email", "ip", "card", "iban", "phone", "ssn", "date", "secret")

# \d would also match digits of other scripts, which have no place value here.
_PATTERNS = {
    "secret": r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key)\b\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9_\-+/]{16,}={0,2})",
    "iban": r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?P<date>[0-9]{4}([-/.])[0-9]{2}\2[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\3[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])",
    "phone": r"(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9.-]))",
    "card": r"(?<![0-9A-Za-z])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![0-9A-Za-z])",
}


#: An address is a local part, read backward from the @, and a domain.
_LOCAL = re.compile(r"[A-Za-z0-9._%+\-\u00C0-\uFFFF]+")
_FIRST_OF_LOCAL = re.compile(r"[A-Za-z0-9_\u00C0-\uFFFF]")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")


def emails(text: str) -> list[tuple[int, int, int]]:
    """(first place at which its local part may begin, place of the @, end) of every address."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        run = _LOCAL.match(text[done:at][::-1]) if domain else None
        if run:
            out.append((at - run.end(), at, domain.end()))
        done = at + 1
        at = text.find("@", done)
    return out


def number(pattern: dict[str, str]) -> str:
    """One expression of all kinds; date's back references are numbered from its place."""
    out, groups = [], 0
    for k, p in pattern.items():
        if k == "date":
            p = p.replace(r"\2", f"\\{groups + 2}").replace(r"\3", f"\\{groups + 3}")
        out.append(p)
        groups += re.compile(p.replace(f"\\{groups + 2}", "").replace(f"\\{groups + 3}", "") if k == "date" else p).groups
    return "|".join(out)


def permute(x: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of range(size): an alternating Feistel network over a * b >= size, walked back into range."""
    if size < 2:
        return x
    a = 1
    while a * a < size:
        a += 1 if size < 1 << 20 else max(1, (size // max(a, 1) - a) // 2)
    b = -(-size // a)

    def f(i: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|%d|" % (i, size, v) + tweak.encode(), key=key[:64], digest_size=24).digest(), "big")

    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if i % 2:
                right = (right - f(i, left) if inverse else right + f(i, left)) % b
            else:
                left = (left - f(i, right) if inverse else left + f(i, right)) % a
        x = left * b + right
        if x < size:
            return x


def luhn(digits: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def _refill(shape: str, kind: str, values: str) -> str:
    """shape with its characters of the kind replaced by values in order."""
    it = iter(values)
    return "".join(next(it) if (c.isascii() and (c.isdigit() if kind == "d" else c.isalnum())) else c for c in shape)


def _digits(shape: str, key: bytes, tweak: str) -> str:
    d = re.sub("[^0-9]", "", shape)
    return _refill(shape, "d", str(permute(int(d), 10 ** len(d), key, f"{tweak}{len(d)}")).zfill(len(d)))


@functools.cache
def _page(c: str) -> str:
    kind, page = unicodedata.category(c), ord(c) & ~255
    return "".join(x for x in map(chr, range(max(page, 0xC0), page + 256)) if unicodedata.category(x) == kind)


def _letters(shape: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """Mixed radix: every digit, lower and upper letter stays of its class, one beyond ASCII of its category and page of 256."""
    own = [("0123456789abcdef" if hexadecimal and shape.lower() == shape else "0123456789ABCDEF") if hexadecimal else _page(c) if c >= "\u00c0" else next((s for s in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in s), None) for c in shape]
    x, size = 0, 1
    for c, s in zip(shape, own, strict=True):
        if s:
            x, size = x * len(s) + s.index(c), size * len(s)
    form = "".join("x" if not s else str(len(s)) + s[0] for s in own)
    y, out = permute(x, size, key, f"{tweak}{form}"), []
    for c, s in zip(reversed(shape), reversed(own), strict=True):
        if s:
            y, r = divmod(y, len(s))
            out.append(s[r])
        else:
            out.append(c)
    return "".join(reversed(out))


def _card(v: str, key: bytes) -> str | None:
    d = re.sub("[^0-9]", "", v)
    if not luhn(d) or set(d) == {"0"}:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, f"card{len(d)}")).zfill(len(d) - 1)
    return _refill(v, "d", body + next(c for c in "0123456789" if luhn(body + c)))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(v: str, key: bytes) -> str | None:
    s = v.replace(" ", "")
    if not 15 <= len(s) <= 34 or _mod97(s) != 1:
        return None
    body = _letters(s[4:], key, f"iban{s[:2]}")
    return _refill(v, "a", s[:2] + f"{98 - _mod97(s[:2] + '00' + body):02d}" + body)


def _ip(v: str, key: bytes) -> str | None:
    o = [int(x) for x in v.split(".")]
    if max(o) > 255:
        return None
    x = permute(int.from_bytes(bytes(o), "big"), 1 << 32, key, "ip").to_bytes(4, "big")
    return ".".join(map(str, x))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(v: str, key: bytes) -> str | None:
    a, b, c = (int(x) for x in re.split(r"[-/.]", v))
    sep = v[4] if v[4] in "-/." else v[2]
    year_first = v[4] == sep
    y, m, d = (a, b, c) if year_first else (c, b, a)
    month_first = not year_first and m > 12
    if month_first:
        m, d = d, m
    if not (1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    days = _LAST - _FIRST + 1
    # a date that could be read day first or month first is one of a pair of readings; each form keeps its own permutation
    form = "ymd" if year_first else "mdy" if month_first else "dmy"
    x = datetime.date(y, m, d).toordinal() - _FIRST
    while True:
        x = permute(x, days, key, f"date{form}")
        n = datetime.date.fromordinal(_FIRST + x)
        if form != "mdy" or n.day > 12:
            break
    return sep.join((f"{n.year:04d}", f"{n.month:02d}", f"{n.day:02d}") if year_first else (f"{n.month:02d}", f"{n.day:02d}", f"{n.year:04d}") if month_first else (f"{n.day:02d}", f"{n.month:02d}", f"{n.year:04d}"))


def _email(v: str, key: bytes) -> str:
    local, _, domain = v.partition("@")
    host, _, top = domain.rpartition(".")
    return f"{_letters(local, key, 'local')}@{_letters(host, key, 'domain')}.{top}"


def _phone(v: str, key: bytes) -> str | None:
    d = re.sub("[^0-9]", "", v)
    if not 7 <= len(d) <= 15:
        return None
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", v)  # the country stays
    head = code.group() if code else ""
    return head + _digits(v[len(head) :], key, f"phone{head}")


def _secret(v: str, key: bytes) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v):
        return _letters(v, key, "secret", hexadecimal=True)
    return _letters(v, key, "secret")


def _ssn(v: str, key: bytes) -> str | None:
    a, b, c = v.split("-")
    return None if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else _digits(v, key, "ssn")


_REPLACE = {"email": _email, "ip": _ip, "card": _card, "iban": _iban, "phone": _phone, "ssn": _ssn, "date": _date, "secret": _secret}


def pseudonymize(text: str, regex: re.Pattern, key: bytes, counts: dict[str, int], memo: dict) -> str:
    def one(kind: str, v: str) -> str | None:
        new = memo.get((kind, v), memo)
        if new is memo:
            new = memo[kind, v] = _REPLACE[kind](v, key)
            if len(memo) > 100_000:
                memo.clear()
        counts[kind] += new is not None
        return new

    out, at, places = [], 0, iter(emails(text) if "@" in text else ())
    mail, m = next(places, None), regex.search(text)
    while mail or m:
        if mail:  # what came before may have taken the beginning of its local part
            first = _FIRST_OF_LOCAL.search(text, max(mail[0], at), mail[1]) if at <= mail[1] else None
            if not first:
                mail = next(places, None)
                continue
        if m and m.start() < at:
            m = regex.search(text, at)
            continue
        if m and (not mail or m.start() < first.start() or (m.start() == first.start() and m.group("secret") is not None)):
            kind = m.lastgroup if m.lastgroup in _REPLACE else next(k for k in KINDS if k != "email" and m.group(k) is not None)
            lo, hi, end = *m.span(kind), m.end()
        else:
            kind, lo, hi, end = "email", first.start(), mail[2], mail[2]
        new = one(kind, text[lo:hi])
        out += (text[at:lo], text[lo:hi] if new is None else new)
        out.append(text[hi:end])
        at = end
        if kind == "email":
            mail = next(places, None)
        else:
            m = regex.search(text, at)
    return "".join((*out, text[at:]))


def _rewrite(key: bytes, text: str, extra: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    regex, memo = re.compile(number(_PATTERNS)), {}
    for batch in batches:
        for p in pieces(batch, text, 1 << 22):
            arr = column(p, text)
            # every kind but a secret of letters holds a digit
            some = pc.fill_null(pc.match_substring_regex(arr, r"[0-9@]|(?i:token|secret|passw|pwd|key)"), False)
            at = [i for i, x in enumerate(some.to_pylist()) if x]
            values, found = {}, {}
            for i in at:
                counts = dict.fromkeys(KINDS, 0)
                old = arr[i].as_py()
                new = pseudonymize(old, regex, key, counts, memo)
                if new != old:
                    values[i] = new
                found[i] = counts
            if values:
                mask = pa.array([i in values for i in range(len(arr))])
                arr = pc.replace_with_mask(arr, mask, pa.array([values[i] for i in sorted(values)], arr.type))
            cols = [arr if n == text else c for n, c in zip(p.schema.names, p.columns, strict=True)]
            if extra:
                nulls = arr.is_null().to_pylist()
                cols += [pa.array([None if nulls[i] else found.get(i, {}).get(k, 0) for i in range(len(arr))], pa.int32()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(cols, [*p.schema.names, *extra])


def pseudonyms(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """docs with its text rewritten; every other column as it was."""
    return docs.mapInArrow(functools.partial(_rewrite, key, text_col, []), docs.schema)


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """(doc_id, text, n_email, n_ip, ...): the rewritten texts and how many values of each kind were replaced."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    names = [fresh(f"n_{k}", slim.columns) for k in KINDS]
    schema = T.StructType([*slim.schema.fields, *(T.StructField(n, T.IntegerType()) for n in names)])
    return slim.mapInArrow(functools.partial(_rewrite, key, "text", names), schema)
