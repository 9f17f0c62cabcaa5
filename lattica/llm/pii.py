"""Operator 10: format-preserving Feistel pseudonyms for personal numbers, dates, addresses and keys.

A value is replaced only once it passes its own validation (Luhn, mod 97, octet ranges, calendar).
The replacement comes from a keyed Feistel permutation of the set of valid values of that format,
so it passes the same validation, has the same layout, and equal values stay equal in every document
while different values of a format stay different.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.runtime import ship

#: The session setting that holds the key of the query and of the pipeline.
KEY_CONF = "spark.lattica.pii.key"
ROUNDS = 10
#: Longer strings are permuted with arrays.
MANY_PLACES = 48
_DRAWN: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key in ``spark.lattica.pii.key``; where that is unset, one drawn at random for this application.

    With a drawn key equal values are linked within the application only, and nobody can undo them.
    """
    own = spark.conf.get(KEY_CONF, None)
    if own:
        return own.encode()
    return _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


class Feistel:
    """Keyed permutation of range(size), a size of at most 2**128, with tweak ``label``; cycle walking keeps results in range."""

    def __init__(self, key: bytes, label: str, size: int):
        self.size = size
        self.left = math.isqrt(max(size - 1, 0)) + 1
        self.right = -(-size // self.left)
        self.state = hashlib.blake2b(label.encode() + size.to_bytes(64, "big"), key=hashlib.sha256(key).digest(), digest_size=24)

    def _round(self, i: int, half: int) -> int:
        h = self.state.copy()
        h.update(b"%d:%d" % (i, half))
        return int.from_bytes(h.digest(), "big")

    def _once(self, x: int) -> int:
        a, b = x % self.left, x // self.left
        for i in range(ROUNDS):
            if i % 2:
                b = (b + self._round(i, a)) % self.right
            else:
                a = (a + self._round(i, b)) % self.left
        return b * self.left + a

    def _back(self, x: int) -> int:
        a, b = x % self.left, x // self.left
        for i in reversed(range(ROUNDS)):
            if i % 2:
                b = (b - self._round(i, a)) % self.right
            else:
                a = (a - self._round(i, b)) % self.left
        return b * self.left + a

    def encrypt(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def decrypt(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x


class Places:
    """Keyed permutation of the strings with given alphabets at their places, of any length, in linear time.

    A Feistel network whose halves are the first and the second half of the places: each round adds a
    keystream, made from the other half, to every place modulo its alphabet's size.
    """

    def __init__(self, key: bytes, label: str, sizes: list[int]):
        self.sizes = sizes
        self.cut = len(sizes) // 2
        self.label = hashlib.sha256(key).digest() + label.encode() + b"|"

    def _stream(self, i: int, other: bytes, n: int) -> bytes:
        return hashlib.shake_256(self.label + b"%d:" % i + other).digest(8 * n)

    def _run(self, values: list[int], rounds: Iterator[int], sign: int) -> list[int]:
        many = len(values) > MANY_PLACES
        halves = [bytes(values[: self.cut]), bytes(values[self.cut :])]
        sizes = [self.sizes[: self.cut], self.sizes[self.cut :]]
        for i in rounds:
            own, other = halves[i % 2], halves[1 - i % 2]
            stream = self._stream(i, other, len(own))
            if many:
                add = np.frombuffer(stream, ">u8") % np.array(sizes[i % 2], np.uint64)
                moved = (np.frombuffer(own, np.uint8).astype(np.int64) + sign * add.astype(np.int64)) % np.array(sizes[i % 2], np.int64)
                halves[i % 2] = moved.astype(np.uint8).tobytes()
            else:
                halves[i % 2] = bytes((v + sign * int.from_bytes(stream[8 * k : 8 * k + 8], "big")) % n for k, (v, n) in enumerate(zip(own, sizes[i % 2])))
        return list(halves[0] + halves[1])

    def encrypt(self, values: list[int]) -> list[int]:
        return self._run(values, range(ROUNDS), 1)

    def decrypt(self, values: list[int]) -> list[int]:
        return self._run(values, reversed(range(ROUNDS)), -1)


def luhn_digit(body: str) -> str:
    total = 0
    for i, ch in enumerate(reversed(body)):
        v = int(ch)
        if i % 2 == 0:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return str(-total % 10)


def _iban_remainder(text: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in text[4:] + text[:4])) % 97


MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
#: Days of these years stay among themselves, and so do all other days.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

#: A card may stand among other numbers: whole groups of digits, 19 digits at most, and cut shorter where they fail.
_CARD = r"(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![0-9A-Za-z_])"
#: Alternatives are tried from left to right at each place, the most specific first.
_NUMBERS = (
    r"(?<![0-9A-Za-z_])(?:"
    r"(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z_])"
    r"|(?P<ip>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?![0-9A-Za-z_]|\.[0-9])"
    r"|(?P<iso>[0-9]{4}([-/.])[0-9]{1,2}\4[0-9]{1,2})(?!(?![Tt][0-9])[0-9A-Za-z_]|[-/.][0-9])"
    r"|(?P<dmy>[0-9]{1,2}([-/.])[0-9]{1,2}\6[0-9]{4})(?![0-9A-Za-z_]|[-/.][0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z_]|-[0-9])"
    r"|<card>"
    r"|(?P<phone>(?:\(?[0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z_]|-[0-9])"
    r"|(?P<named>[0-9]{1,2}(?:st|nd|rd|th)? (?i:january|february|march|april|may|june|july|august|september|october|november|december),? [0-9]{4})(?![0-9A-Za-z_])"
    r")"
    r"|(?P<intl>\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,5}\)?){2,5})(?![0-9A-Za-z_])"
    r"|(?P<us>(?i:\b(?:january|february|march|april|may|june|july|august|september|october|november|december)) [0-9]{1,2},? [0-9]{4})(?![0-9A-Za-z_])"
    r"|(?P<secret>(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)\b)\s*[=:]\s*[\"']?[A-Za-z0-9+/_-]{16,}[\"']?)"
    r"|(?P<cloud>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)"
)
NUMBERS = re.compile(_NUMBERS.replace("<card>", _CARD))
_BUT_CARDS = re.compile(_NUMBERS.replace("|<card>", ""))
_AT_CARD = re.compile(r"(?<![0-9A-Za-z_])" + _CARD)
#: Digits a group as cards are printed; other groupings count only where nothing else is found.
_PRINTED = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3))
#: A mailbox is sought from its @, forwards for the host and backwards for the local part, so that long runs cost no more than once.
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_LOCAL = re.compile(r"[\w.+%-]+")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALPHABET = {c: (a, i) for a in (_DIGITS, _LOWER, _UPPER) for i, c in enumerate(a)}
_ANY = re.compile(r"[0-9]|(?i:token|secret|passw|key)|A[KS]IA")


def _cuts(text: str) -> Iterator[str]:
    """The text, then shorter and shorter beginnings of whole groups."""
    yield text
    for i in range(len(text) - 1, 0, -1):
        if text[i] in " -":
            yield text[:i]


class Pseudonymizer:
    """Finds and replaces; one instance a task, so that permutations are set up once."""

    def __init__(self, key: bytes):
        self.key = key
        self.cache: dict[tuple[str, int], Feistel] = {}
        self.count = 0

    def permute(self, label: str, size: int, x: int) -> int:
        f = self.cache.get((label, size)) or self.cache.setdefault((label, size), Feistel(self.key, label, size))
        return f.encrypt(x)

    def digits(self, label: str, text: str) -> str:
        """Permute the digits of ``text`` as one number and leave everything between them."""
        own = [int(c) for c in text if c in _DIGITS]
        new = iter(Places(self.key, f"{label}{len(own)}", [10] * len(own)).encrypt(own))
        return re.sub(r"[0-9]", lambda _: str(next(new)), text)

    def letters(self, label: str, text: str) -> str:
        """Permute a mixed string within its own pattern of digit, lower-case and upper-case places."""
        places = [_ALPHABET.get(ch) for ch in text]
        own = [p for p in places if p]
        if not own:  # no such place: the whole is replaced by its keyed digest
            return hashlib.blake2b(text.encode("utf-8", "replace"), key=hashlib.sha256(self.key).digest(), digest_size=6).hexdigest()
        pattern = "".join(p[0][0] if p else "." for p in places)
        new = iter(Places(self.key, label + pattern, [len(a) for a, _ in own]).encrypt([i for _, i in own]))
        return "".join(p[0][next(new)] if p else ch for ch, p in zip(text, places))

    def hexadecimal(self, text: str) -> str:
        new = "".join(f"{v:x}" for v in Places(self.key, f"hex{len(text)}", [16] * len(text)).encrypt([int(c, 16) for c in text]))
        return new.upper() if text.upper() == text else new

    def card(self, text: str) -> str | None:
        own = re.sub(r"[^0-9]", "", text)
        if not 13 <= len(own) <= 19 or luhn_digit(own[:-1]) != own[-1] or len(set(own)) == 1:
            return None
        body = f"{self.permute(f'card{len(own)}', 10 ** (len(own) - 1), int(own[:-1])):0{len(own) - 1}d}"
        new = iter(body + luhn_digit(body))
        return re.sub(r"[0-9]", lambda _: next(new), text)

    def day(self, date: dt.date) -> dt.date:
        n, inside = date.toordinal(), LAST_DAY - FIRST_DAY + 1
        if FIRST_DAY <= n <= LAST_DAY:
            return dt.date.fromordinal(FIRST_DAY + self.permute("day", inside, n - FIRST_DAY))
        n = self.permute("far day", dt.date.max.toordinal() - inside, n - 1 - inside * (n > LAST_DAY)) + 1
        return dt.date.fromordinal(n + inside * (n >= FIRST_DAY))

    def date(self, text: str, order: str) -> str | None:
        """Any layout of three numbers or of a month's name; order gives their meaning, as 'ymd'."""
        parts = re.findall(r"[0-9]+|(?i:january|february|march|april|may|june|july|august|september|october|november|december)", text)
        value = [MONTHS.get(p.lower()) or int(p) for p in parts]
        for guess in (order, order.replace("d", "_").replace("m", "d").replace("_", "m")) if order != "ymd" and all(p.isdigit() for p in parts) else (order,):
            try:
                new = self.day(dt.date(*(value[guess.index(c)] for c in "ymd")))
            except ValueError:
                continue
            by = {"y": new.year, "m": new.month, "d": new.day}
            fill = iter(guess)
            # Days and months keep two digits unless the value itself shows one without a leading zero.
            width = 2 if all(len(p) == 2 for c, p in zip(guess, parts) if c != "y" and p.isdigit()) else 1

            def put(m: re.Match) -> str:
                c, old = next(fill), m.group()
                if old.isdigit():
                    return f"{by[c]:0{len(old) if c == 'y' else width}d}"
                name = next(k for k, v in MONTHS.items() if v == by[c])
                return name.upper() if old.isupper() else name.capitalize() if old[0].isupper() else name

            return re.sub(r"[0-9]+|(?i:january|february|march|april|may|june|july|august|september|october|november|december)", put, text)
        return None

    def ip(self, text: str) -> str | None:
        octets = [int(p) for p in text.split(".")]
        if max(octets) > 255:
            return None
        x = int.from_bytes(bytes(octets), "big")
        return ".".join(map(str, self.permute("ip", 1 << 32, x).to_bytes(4, "big")))

    def iban(self, text: str) -> str | None:
        own = text.replace(" ", "")
        if not 15 <= len(own) <= 34 or _iban_remainder(own) != 1:
            return None
        body = self.letters("iban", own[4:])
        new = iter(own[:2] + f"{98 - _iban_remainder(own[:2] + '00' + body):02d}" + body)
        return re.sub(r"[^ ]", lambda _: next(new), text)

    def ssn(self, text: str) -> str | None:
        a, b, c = int(text[:3]), int(text[4:6]), int(text[7:])
        if a in (0, 666) or a > 899 or not b or not c:
            return None
        x = self.permute("ssn", 898 * 99 * 9999, ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1)
        x, c = divmod(x, 9999)
        a, b = divmod(x, 99)
        a += 1 + (a >= 665)
        return f"{a:03d}-{b + 1:02d}-{c + 1:04d}"

    def secret(self, text: str) -> str | None:
        m = re.fullmatch(r"(.*?[=:]\s*[\"']?)([A-Za-z0-9+/_-]{16,})([\"']?)", text, re.S)
        value = m.group(2)
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
            return m.group(1) + self.hexadecimal(value) + m.group(3)
        if not re.search(r"[0-9]", value):
            return None
        return m.group(1) + self.letters("key", value) + m.group(3)

    def phone(self, text: str) -> str | None:
        n = len(re.sub(r"[^0-9]", "", text))
        if not 7 <= n <= 15:
            return None
        if text[0] == "+":  # the country code stays
            head = re.match(r"\+[0-9]{1,3}", text).group() if not text[1:].isdigit() else text[:2]
            return head + self.digits("phone" + head, text[len(head) :])
        return self.digits("phone", text)

    def email(self, local: str, host: str) -> str:
        host, dot, top = host.rpartition(".")
        return f"{self.letters('mail', local)}@{self.letters('host', host)}{dot}{top}"

    def emails(self, text: str) -> str:
        out, done, at = [], 0, 0
        while (at := text.find("@", at)) >= 0:
            host = _HOST.match(text, at + 1)
            # The text since the last @ or mailbox, from its end: every character is looked at once.
            local = _LOCAL.match(text[max(done, text.rfind("@", done, at) + 1) : at][::-1]) if host else None
            at += 1
            if local:
                start, at = at - 1 - local.end(), host.end()
                out += text[done:start], self.email(text[start : host.start() - 1], host.group())
                done = at
                self.count += 1
        return "".join(out) + text[done:]

    def printed(self, text: str, start: int) -> tuple[int, str] | None:
        """End and replacement of the card that starts at ``start`` in one group or in groups as cards are printed."""
        m = _AT_CARD.match(text, start)
        if not m:
            return None
        groups = re.split("[ -]", m.group())
        sizes = tuple(map(len, groups))
        for n in [len(p) for p in _PRINTED if sizes[: len(p)] == p] + [1] * (sizes[0] >= 13):
            part = m.group()[: sum(sizes[:n]) + n - 1]
            if (new := self.card(part)) is not None:
                return start + len(part), new
        return None

    def other(self, text: str, start: int) -> tuple[int, str] | None:
        """End and replacement of a valid value at ``start`` that is no card."""
        m = _BUT_CARDS.match(text, start)
        new = self.value(m.lastgroup, m.group()) if m else None
        return None if new is None else (m.end(), new)

    def sure(self, text: str, start: int) -> tuple[int, str] | None:
        """What ``printed`` or else ``other`` finds at ``start``; kept, as neighbours ask again."""
        if start not in self.known:
            self.known[start] = self.printed(text, start) or self.other(text, start)
        return self.known[start]

    def card_or_other(self, text: str, m: re.Match) -> tuple[int, str | None]:
        """End and replacement of what starts with these digits, or the end of the first group and None."""
        start, whole = m.span()
        if found := self.sure(text, start):
            return found
        for part in _cuts(m.group()):
            if sum(map(str.isdigit, part)) < 13:
                break
            if (new := self.card(part)) is not None:
                groups = [start + g.start() for g in re.finditer("[0-9]+", text[start:whole])]
                if any(self.sure(text, g) for g in groups[1:]):
                    break
                return start + len(part), new
        return start + re.match("[0-9]+", m.group()).end(), None

    def value(self, kind: str, text: str) -> str | None:
        if kind in ("iso", "dmy", "named", "us"):
            return self.date(text, {"iso": "ymd", "dmy": "dmy", "named": "dmy", "us": "mdy"}[kind])
        if kind in ("phone", "intl"):
            return self.phone(text)
        if kind == "cloud":
            return text[:4] + self.letters("cloud", text[4:])
        return getattr(self, kind)(text)

    def numbers(self, text: str) -> str:
        out, done, at = [], 0, 0
        self.known: dict[int, tuple[int, str] | None] = {}
        while m := NUMBERS.search(text, at):
            start, at = m.span()
            if m.lastgroup == "card":
                at, new = self.card_or_other(text, m)
            elif m.lastgroup == "iban":
                for part in _cuts(m.group()):  # the last part is the first group, which is no IBAN unless it is whole
                    at, new = start + len(part), self.iban(part)
                    if new is not None:
                        break
            else:
                new = self.value(m.lastgroup, m.group())
            if new is not None:
                out += text[done:start], new
                done = at
                self.count += 1
        return "".join(out) + text[done:]

    def __call__(self, text: str | None) -> tuple[str | None, int]:
        """The text with its values replaced, and how many there were."""
        self.count = 0
        if not text:
            return text, 0
        if "@" in text:
            text = self.emails(text)
        if _ANY.search(text):
            text = self.numbers(text)
        return text, self.count


def _replacer(key: bytes) -> Callable:
    @F.pandas_udf("text string, found int")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = Pseudonymizer(key)
        for texts in batches:
            out = [work(t) for t in texts]
            yield pd.DataFrame({"text": [t for t, _ in out], "found": pd.Series([n for _, n in out], dtype="int32")})

    return replace


def replaced(text: Column, key: bytes) -> Column:
    """Struct ``(text, found)`` of a text column; a null text stays null with 0 found."""
    ship(SparkSession.active())
    return _replacer(key)(text)


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with the values in ``text`` replaced; same rows, same columns, ``n_chars`` counted anew.

    ``key`` is the caller's; who has it can link and undo. Narrow: texts cross to Python once in Arrow
    batches, nothing is shuffled. Null and empty texts stay as they are, repeated rows get the same
    replacements, an empty table stays empty, and other columns, whatever their names, pass through.
    Texts and values may be of any length; the time grows with the length. All valid calendar days are
    dates, those of 1900 to 2099 among themselves. Of telephone numbers only the form and the number
    of digits can be checked.
    """
    out = docs.withColumn("text", replaced(F.col("text"), key)["text"])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's id, its text with pseudonyms, and the number of values replaced in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", replaced(F.col("text"), session_key(spark)).alias("r")).select("doc_id", "r.text", F.col("r.found").alias("pii_found"))
