"""Operator 7: format-preserving pseudonyms for personal data.

Numbers and dates that pass their own validation (check digits, calendar,
numbering plans) are put through a keyed Feistel permutation of the set of
valid values of their format: the result has the same length, separators and
classes of characters, passes the same validation, and equal values have equal
pseudonyms in every document.  Ten-digit numbers outside the numbering plan,
cards with a leading 0 and addresses that aren't public are permuted among
themselves.  Addresses of e-mail and hexadecimal or prefixed secrets are
permuted in the same way, class by class.

Defined results: null texts stay null, empty ones empty; text without a
validated value comes back as it was, however long; rows are handled each for
itself, so repeats and ties stay; an empty table gives no rows; other columns
pass unread.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For tests and the registered query; a production run passes its own secret.
DEFAULT_KEY = b"textloom pseudonyms"
ROUNDS = 8
KINDS = ("email", "phone", "card", "ssn", "iban", "ip", "date", "secret")


class Feistel:
    """Keyed permutations of range(size) for any size."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, i: int, tweak: str, size: int, value: int, modulus: int) -> int:
        width = (modulus.bit_length() + 7) // 8 + 8
        seed = self.key + b"|" + f"{i}|{tweak}|{size}|{value}".encode()
        return int.from_bytes(hashlib.shake_256(seed).digest(width), "big") % modulus

    @staticmethod
    def _halves(size: int) -> tuple[int, int]:
        a = max(1, 1 << (size.bit_length() // 2))
        return a, -(-size // a)

    def once(self, value: int, size: int, tweak: str) -> int:
        a, b = self._halves(size)
        while True:
            left, right = divmod(value, b)
            for i in range(0, ROUNDS, 2):
                left = (left + self._round(i, tweak, size, right, a)) % a
                right = (right + self._round(i + 1, tweak, size, left, b)) % b
            value = left * b + right
            if value < size:
                return value

    def back(self, value: int, size: int, tweak: str) -> int:
        a, b = self._halves(size)
        while True:
            left, right = divmod(value, b)
            for i in reversed(range(0, ROUNDS, 2)):
                right = (right - self._round(i + 1, tweak, size, left, b)) % b
                left = (left - self._round(i, tweak, size, right, a)) % a
            value = left * b + right
            if value < size:
                return value

    def walk(self, value: int, size: int, tweak: str, valid: Callable[[int], bool]) -> int:
        """Permutes the valid members of range(size); ``value`` is one of them."""
        value = self.once(value, size, tweak)
        while not valid(value):
            value = self.once(value, size, tweak)
        return value


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _with_digits(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    rest = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(rest), text)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _by_class(feistel: Feistel, text: str, tweak: str, classes: tuple[str, ...] = _CLASSES) -> str:
    """Every digit becomes a digit and every letter one of its case, as one permuted number."""
    value, size, places = 0, 1, []
    for c in text:
        kind = next((k for k in classes if c in k), None)
        places.append(kind)
        if kind:
            value, size = value * len(kind) + kind.index(c), size * len(kind)
    shape = "".join(str(classes.index(k)) if k else c for c, k in zip(text, places))
    value = feistel.once(value, size, f"{tweak}|{shape}")
    out = []
    for c, kind in zip(reversed(text), reversed(places)):
        if kind:
            value, k = divmod(value, len(kind))
            c = kind[k]
        out.append(c)
    return "".join(reversed(out))


def _email(feistel: Feistel, text: str) -> str:
    """One pseudonym for an address however it is capitalised, capitalised alike."""
    head, _, last = text.rpartition(".")
    made = _by_class(feistel, head.lower(), "email")
    return "".join(c.upper() if h.isupper() else c for c, h in zip(made, head)) + "." + last


def _card(feistel: Feistel, text: str) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    if not 13 <= len(digits) <= 19 or not luhn(digits):
        return None
    size, least = 10 ** (len(digits) - 1), 10 ** (len(digits) - 2)
    if digits[0] == "0":
        body = f"{feistel.once(int(digits[:-1]), least, 'card'):0{len(digits) - 1}d}"
    else:
        body = str(feistel.walk(int(digits[:-1]), size, "card", lambda v: v >= least))
    return _with_digits(text, next(body + c for c in "0123456789" if luhn(body + c)))


def _ssn(feistel: Feistel, text: str) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not area or area == 666 or area >= 900 or not group or not serial:
        return None
    value = feistel.walk((area * 99 + group - 1) * 9999 + serial - 1, 900 * 99 * 9999, "ssn", lambda v: v // (99 * 9999) not in (0, 666))
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban_sum(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(feistel: Feistel, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_sum(plain) != 1:
        return None
    body = _by_class(feistel, plain[4:], "iban" + plain[:2])
    check = 98 - _iban_sum(plain[:2] + "00" + body)
    made = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(made) for c in text)


#: Addresses that every machine or network has alike, and that stay.
_SAME_EVERYWHERE = frozenset((0x7F000001, 0x0A000001))


def _public(value: int) -> bool:
    return value >> 24 not in (0, 10, 127) and value >> 24 < 224


def _other(value: int) -> bool:
    return not _public(value) and value not in _SAME_EVERYWHERE


def _ip(feistel: Feistel, text: str) -> str | None:
    """Public addresses among themselves, and the others; octets with leading zeros keep their width."""
    parts = text.split(".")
    if max(map(int, parts)) > 255:
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    if value in _SAME_EVERYWHERE:
        return None
    made = feistel.walk(value, 1 << 32, "ip", _public if _public(value) else _other).to_bytes(4, "big")
    return ".".join(f"{n:0{len(p)}d}" if p[0] == "0" else str(n) for n, p in zip(made, parts))


def _planned(value: int) -> bool:
    """Whether a ten-digit number's area code and exchange are in the numbering plan."""
    return value >= 2 * 10**9 and value // 10**6 % 10 > 1


def _phone(feistel: Feistel, text: str) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    national = digits[1:] if text.startswith("+1") and len(digits) == 11 else digits if len(digits) == 10 and not text.startswith("+") else None
    if national:
        if not _planned(int(national)):
            value = feistel.walk(int(national), 10**10, "phone", lambda v: not _planned(v))
            return _with_digits(text, f"{digits[: len(digits) - 10]}{value:010d}")
        area, exchange, line = int(national[:3]) - 200, int(national[3:6]) - 200, int(national[6:])
        value = feistel.once((area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000, "phone")
        value, line = divmod(value, 10_000)
        area, exchange = divmod(value, 800)
        return _with_digits(text, digits[: len(digits) - 10] + f"{area + 200}{exchange + 200}{line:04d}")
    if not text.startswith("+") or not 8 <= len(digits) <= 15 or digits[0] == "0":
        return None
    kept = len(re.match(r"\+([0-9]{1,3})", text)[1]) if re.match(r"\+[0-9]{1,3}[^0-9]", text) else 2
    rest = digits[kept:]
    return _with_digits(text, digits[:kept] + f"{feistel.once(int(rest), 10 ** len(rest), 'phone' + digits[:kept]):0{len(rest)}d}")


#: Names of the months as dates have them.
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_FIRST, _LAST = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
_DAYS = (_LAST - _FIRST).days + 1
_MONTH_NAME = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS) + ")"


def _day(year: str, month: str | int, day: str) -> datetime.date | None:
    try:
        found = datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None
    return found if _FIRST <= found <= _LAST else None


def _date(feistel: Feistel, text: str) -> str | None:
    """Year first, day first (else month first), or with the name of the month."""
    moved = lambda d: _FIRST + datetime.timedelta(feistel.once((d - _FIRST).days, _DAYS, "date"))
    like = lambda n, old: f"{n:02d}" if len(old) == 2 and (old[0] == "0" or int(old) > 9) else str(n)
    if m := re.fullmatch(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", text):
        if not (d := _day(m[1], m[3], m[4])):
            return None
        d = moved(d)
        return f"{d.year}{m[2]}{like(d.month, m[3])}{m[2]}{like(d.day, m[4])}"
    if m := re.fullmatch(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})", text):
        if d := _day(m[4], m[3], m[1]):
            d = moved(d)
            return f"{like(d.day, m[1])}{m[2]}{like(d.month, m[3])}{m[2]}{d.year}"
        if d := _day(m[4], m[1], m[3]):
            d = moved(d)
            return f"{like(d.month, m[1])}{m[2]}{like(d.day, m[3])}{m[2]}{d.year}"
        return None
    m = re.fullmatch(rf"(?:(\d{{1,2}})( ))?({_MONTH_NAME})(?: (\d{{1,2}}))?(,? )(\d{{4}})", text)
    if not m or (m[1] is None) == (m[4] is None):
        return None
    number = next(k for k, name in enumerate(_MONTHS, 1) if name.startswith(m[3]))
    d = _day(m[6], number, m[1] or m[4])
    if not d:
        return None
    d = moved(d)
    name = _MONTHS[d.month - 1] if len(m[3]) > 3 or m[3] == "May" else _MONTHS[d.month - 1][:3]
    return f"{like(d.day, m[1])} {name}{m[5]}{d.year}" if m[1] else f"{name} {like(d.day, m[4])}{m[5]}{d.year}"


_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def _secret(feistel: Feistel, text: str) -> str | None:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        kinds = set(map(str.isdigit, text))
        return _by_class(feistel, text, "hex", (_HEX[0] if text.lower() == text else _HEX[1],)) if len(kinds) == 2 else None
    prefix = re.match(r"AKIA|sk-|gh[opsu]_|xox[bp]-", text)[0]
    return prefix + _by_class(feistel, text[len(prefix) :], "secret" + prefix)


_FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,64}|gh[opsu]_[A-Za-z0-9]{36}|xox[bp]-[A-Za-z0-9-]{10,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": rf"(?<![0-9./-])(?:[0-9]{{4}}([-/.])[0-9]{{1,2}}\1[0-9]{{1,2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\2[0-9]{{4}})(?![0-9])(?![./-][0-9])|(?<!\w)(?:[0-9]{{1,2}} {_MONTH_NAME}|{_MONTH_NAME} [0-9]{{1,2}}),? [0-9]{{4}}(?![0-9])",
    "phone": r"(?<![\w+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![\w+])\+(?!1[ .(-])[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,3}(?![0-9])|(?<![\w+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])(?![.-][0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
_FORM = {kind: re.compile(form) for kind, form in _FORMS.items()}
_ANY = re.compile(r"[0-9@]|gh[opsu]_|sk-|xox[bp]-")
_MAKE = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


class Pseudonymiser:
    """Replaces validated values; remembers a bounded number of them."""

    def __init__(self, key: bytes = DEFAULT_KEY, keep: int = 100_000):
        self.feistel, self.keep, self.known = Feistel(key), keep, {}

    def value(self, kind: str, text: str) -> str | None:
        """A value's pseudonym, or None if it isn't valid."""
        known = self.known
        if (kind, text) not in known:
            if len(known) > self.keep:
                known.clear()
            known[kind, text] = _MAKE[kind](self.feistel, text)
        return known[kind, text]

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of every validated value, without overlaps."""
        if not _ANY.search(text):
            return []
        found: list[tuple[int, int, str, str]] = []
        taken: list[tuple[int, int]] = []
        for kind, form in _FORM.items():
            fresh = []
            for m in form.finditer(text):
                if (made := self.value(kind, m[0])) is not None:
                    fresh.append((m.start(), m.end(), kind, made))
            if fresh:
                fresh = [s for s in fresh if not _overlaps(taken, s[0], s[1])]
                found += fresh
                taken = sorted((s[0], s[1]) for s in found)
        return sorted(found)

    def replaced(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        spans = self.spans(text)
        if not spans:
            return text, spans
        out, at = [], 0
        for start, end, _, made in spans:
            out += [text[at:start], made]
            at = end
        return "".join(out) + text[at:], spans


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    from bisect import bisect_left

    k = bisect_left(taken, (start, start))
    return (k < len(taken) and taken[k][0] < end) or (k > 0 and taken[k - 1][1] > start)


def pseudonymised(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, text with pseudonyms, n_pii and a count of each kind."""

    def replace(batches: Iterator[pa.RecordBatch]):
        own = Pseudonymiser(key)
        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for text in batch.column("text").to_pylist():
                made, spans = own.replaced(text) if text else (text, [])
                texts.append(made)
                kinds = [s[2] for s in spans]
                for k in KINDS:
                    counts[k].append(kinds.count(k))
            out = {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "n_pii": pa.array([sum(x) for x in zip(*counts.values())], pa.int32())}
            yield pa.RecordBatch.from_pydict(out | {f"n_{k}": pa.array(v, pa.int32()) for k, v in counts.items()})

    schema = "doc_id long, text string, n_pii int, " + ", ".join(f"n_{k} int" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(replace, schema)


def replaced(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """The rows of ``docs``, whole, with pseudonyms in their texts and n_chars, where there is one, to match."""

    def replace(batches: Iterator[pa.RecordBatch]):
        own = Pseudonymiser(key)
        for batch in batches:
            texts = [own.replaced(t)[0] if t else t for t in batch.column("text").to_pylist()]
            columns = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns["n_chars"].to_pylist())], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([new.get(name, column) for name, column in columns.items()], list(columns))

    return docs.mapInArrow(replace, docs.schema)
