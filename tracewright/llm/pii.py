"""Personal data: keyed, format-preserving pseudonyms by Feistel permutation.

A text is scanned for candidates; each is validated (Luhn and ISO 7064 check digits,
calendar, ranges of address and number parts) with all shorter ones that start with it and
end where a group of characters ends, as other numbers or capitals may follow a value. If
none is valid the scan goes on behind the first group. A valid candidate is replaced by the image of its value under
a keyed permutation of all values of its format: as many digits, the same separators, a
valid check digit, an existing date. A permutation has no table, so equal values get equal
pseudonyms in every document, task and run with one key, and different ones stay apart.
Values are normalised first, so ``4929-3483-...`` and ``49293483...`` stay linked.

Rows are independent: one ``mapInArrow`` pass without a shuffle.

Defined cases: null text stays null with no findings; empty text stays empty; text
without valid candidates is returned unchanged to the byte; ids may be null or repeated;
other columns pass through, but those named like a count are replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import bounded_batches, table, unused

ROUNDS = 10
#: Known to everybody: for the query over the test tables alone.
DEMO_KEY = b"replace this key"
KINDS = ["email", "secret", "iban", "date", "phone", "ip", "ssn", "card"]

_FIND = re.compile(
    r"""
      (?P<email>(?<![\w.+-])[A-Za-z0-9À-ÖØ-öø-ÿ][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    | (?P<secret>(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)\s*[:=]\s*["']?[0-9a-fA-F]{8,128}(?![0-9A-Za-z])|\bAKIA[0-9A-Z]{12,20}(?![0-9A-Za-z]))
    | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
    | (?P<date>(?<!\d)(?<!\d[./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\d/-])(?!\.\d))
    | (?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\w(])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![\d-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\d-]))
    | (?P<ip>(?<![\d.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\d])(?!\.\d))
    | (?P<ssn>(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-]))
    | (?P<card>(?<![\d])(?:[0-9][ -]?){12,18}[0-9](?![\d]))
    """,
    re.VERBOSE,
)
#: The pattern of each kind by itself, in order, for what else may start where a candidate failed.
_EACH = [(kind, re.compile(part.strip(), re.VERBOSE)) for kind, part in zip(KINDS, re.split(r"\n +\| ", _FIND.pattern))]
_MAYBE = re.compile(r"[0-9@]")
_GROUP = re.compile(r"[A-Za-z0-9]+")
_DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
#: Lengths of IBANs by country; those of others are not known here.
_IBAN_LENGTH = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}
_EPOCH, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Permutations of ``range(n)`` for every ``n``, told apart by ``tweak``."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, n: int, x: int) -> int:
        digest = hmac.digest(self.key, b"%s|%d|%d|%d" % (tweak, i, n, x), hashlib.sha256)
        return int.from_bytes(digest[:24], "big")

    def permute(self, x: int, n: int, tweak: bytes) -> int:
        """The image of ``x``; a walk along the cycle keeps it below ``n``."""
        if n < 2:
            return x
        a = 1
        while a * a < n:
            a <<= 1
        b = -(-n // a)
        while True:
            left, right, ma, mb = x // b, x % b, a, b
            for i in range(ROUNDS):
                left, right, ma, mb = right, (left + self._round(tweak, i, n, right)) % ma, mb, ma
            x = left * mb + right
            if x < n:
                return x

    def invert(self, x: int, n: int, tweak: bytes) -> int:
        if n < 2:
            return x
        a = 1
        while a * a < n:
            a <<= 1
        b = -(-n // a)
        while True:
            left, right, ma, mb = x // b, x % b, a, b
            for i in reversed(range(ROUNDS)):
                left, right, ma, mb = (right - self._round(tweak, i, n, left)) % mb, left, mb, ma
            x = left * mb + right
            if x < n:
                return x

    def digits(self, text: str, tweak: bytes) -> str:
        return str(self.permute(int(text), 10 ** len(text), tweak)).zfill(len(text)) if text else text


def luhn_digit(body: str) -> str:
    total = sum((2 * int(c) - 9 * (c > "4")) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
    return str(-total % 10)


def _mod97(bban: str, head: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban + head)) % 97


def _refill(shape: str, values: str, kind: str = "0123456789") -> str:
    """``shape`` with its characters of ``kind`` replaced in order."""
    it = iter(values)
    return "".join(next(it) if c in kind else c for c in shape)


class Pseudonymizer:
    def __init__(self, key: bytes):
        self.fpe = Feistel(key)
        self.memo: dict[tuple[str, str], str | None] = {}

    def _runs(self, text: str, tweak: bytes) -> str:
        """Letters and digits replaced within their class; all else stays."""
        lower = [c for c in text.lower() if "a" <= c <= "z"]
        digits = "".join(c for c in text if c in "0123456789")
        n = 0
        for c in lower:
            n = n * 26 + ord(c) - 97
        n = self.fpe.permute(n, 26 ** len(lower), tweak + b"a")
        letters = []
        for _ in lower:
            n, d = divmod(n, 26)
            letters.append(chr(97 + d))
        it, jt = iter(reversed(letters)), iter(self.fpe.digits(digits, tweak + b"0"))
        return "".join((next(it).upper() if c.isupper() else next(it)) if "a" <= c.lower() <= "z" and len(c.lower()) == 1 else next(jt) if c in "0123456789" else c for c in text)

    def email(self, text: str) -> str | None:
        local, _, domain = text.partition("@")
        return f"{self._runs(local, b'email' + domain.lower().encode())}@{domain}"

    def secret(self, text: str) -> str | None:
        if text.startswith("AKIA"):
            return "AKIA" + self._runs(text[4:], b"key id")
        body = re.search(r"[0-9a-fA-F]+$", text)[0]
        out = f"{self.fpe.permute(int(body, 16), 16 ** len(body), b'hex'):0{len(body)}x}"
        return text[: len(text) - len(body)] + (out.upper() if body.isupper() else out)

    def iban(self, text: str) -> str | None:
        flat = text.replace(" ", "")
        if not 15 <= len(flat) <= 34 or _mod97(flat[4:], flat[:4]) != 1:
            return None
        bban = self._runs(flat[4:], b"iban" + flat[:2].encode())
        check = 98 - _mod97(bban, flat[:2] + "00")
        return _refill(text, f"{flat[:2]}{check:02d}{bban}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    def date(self, text: str) -> str | None:
        d = [int(x) for x in re.split(r"[-/.]", text)]
        order = (0, 1, 2) if "-" in text else (2, 0, 1) if "/" in text else (2, 1, 0)
        if "/" in text and d[0] > 12:
            order = (2, 1, 0)
        try:
            day = datetime.date(*(d[k] for k in order)).toordinal()
        except ValueError:
            return None
        if not _EPOCH <= day <= _LAST:
            return None
        new = datetime.date.fromordinal(_EPOCH + self.fpe.permute(day - _EPOCH, _LAST - _EPOCH + 1, b"date"))
        parts = dict(zip(order, (new.year, new.month, new.day)))
        return _refill(text, "".join(f"{parts[k]:0{4 if k == order[0] else 2}d}" for k in range(3)))

    def phone(self, text: str) -> str | None:
        flat = re.sub(r"[^0-9]", "", text)
        country = re.match(r"\+([0-9]{1,3})[ .(-]", text)
        code = country[1] if country else "1" if text[0] == "+" and flat[0] == "1" else ""
        if not 7 <= len(flat) - len(code) <= 14 or len(flat) > 15:
            return None
        return _refill(text, code + self.fpe.digits(flat[len(code) :], b"phone" + (code or "1").encode()))

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        new = self.fpe.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
        return ".".join(map(str, new.to_bytes(4, "big")))

    def ssn(self, text: str) -> str | None:
        def valid(n: int) -> bool:
            area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        n = int(text.replace("-", ""))
        if not valid(n):
            return None
        n = self.fpe.permute(n, 10**9, b"ssn")
        while not valid(n):
            n = self.fpe.permute(n, 10**9, b"ssn")
        return _refill(text, f"{n:09d}")

    def card(self, text: str) -> str | None:
        flat = re.sub(r"[ -]", "", text)
        if luhn_digit(flat[:-1]) != flat[-1] or len(set(flat)) == 1:
            return None
        body = self.fpe.digits(flat[:-1], b"card")
        return _refill(text, body + luhn_digit(body))

    def _new(self, kind: str, value: str) -> str | None:
        """The pseudonym of ``value``, or None if it is not valid."""
        if (kind, value) not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[kind, value] = getattr(self, kind)(value)
        return self.memo[kind, value]

    def _starts(self, text: str, at: int, kinds: tuple[str, ...]) -> bool:
        """Whether a valid value of one of ``kinds`` starts at ``at``."""
        return any((m := find.match(text, at)) and self._new(kind, m[0]) is not None for kind, find in _EACH if kind in kinds)

    def _card_end(self, text: str, at: int, worst: int = 2) -> int | None:
        """Where the card that starts at ``at`` ends, among all ends of digit groups.

        One number in ten passes Luhn by chance, so a candidate gives way to one that
        overlaps it in a more usual layout, or to another kind's value inside it.
        """
        # candidates from here span at most 37 characters, as do those that overlap them
        groups = [(m.start() + at, m.end() + at) for m in re.finditer(r"[0-9]+", _DIGITS.match(text, at)[0][:76])]
        if len(groups) > 1 and groups[-1][1] == at + 76:
            groups.pop()  # it may be cut

        def valid(k: int) -> list[tuple[int, int, int]]:
            """(rank, minus the length, end) of the valid cards from group ``k``, best first."""
            out, n, sizes = [], 0, []
            for lo, hi in groups[k:]:
                n += hi - lo
                sizes.append(hi - lo)
                if n > 19:
                    break
                value = text[groups[k][0] : hi]
                if n >= 13 and self._new("card", value) is not None:
                    plain = len(set(value) & set(" -")) < 2
                    if plain and tuple(sizes) in {(16,), (15,), (4, 4, 4, 4), (4, 6, 5)}:
                        rank = 0
                    elif plain and (len(sizes) == 1 or tuple(sizes) == (4, 6, 4) or sizes[:-1] in ([4] * 3, [4] * 4) and sizes[-1] < 4):
                        rank = 1
                    else:
                        rank = 2
                    out.append((rank, -n, hi))
            return sorted(out)

        for rank, _, hi in valid(0):
            inside = [k for k, (lo, _) in enumerate(groups) if k and lo < hi]
            if rank and any(other[0] < rank for k in inside for other in valid(k)[:1]):
                continue
            if rank > worst or rank == 2 and any(self._starts(text, groups[k][0], ("date", "phone", "ssn")) for k in inside):
                continue
            return hi
        return None

    def _end(self, kind: str, text: str, at: int, end: int) -> int | None:
        """Where the valid value of ``kind`` that starts at ``at`` ends; a greedy candidate ends at ``end``."""
        if kind == "card":
            return self._card_end(text, at)
        ends = [end]
        if kind in ("iban", "phone"):
            ends = [at + m.end() for m in _GROUP.finditer(text[at:end])][::-1]
        if kind == "phone":
            # another value behind the number is not a part of it
            starts = [at + m.start() for m in _GROUP.finditer(text[at:end])][1:]
            cut = next((s for s in starts if self._starts(text, s, ("date", "ip", "ssn")) or _EACH[-1][1].match(text, s) and self._card_end(text, s, 0)), end)
            ends = [e for e in ends if e <= cut]
            if re.match(r"\+1[ .(-]", text[at:end]):
                ends.sort(key=lambda e: (sum(c.isdigit() for c in text[at:e]) != 11, -e))
        if kind == "iban":
            length = _IBAN_LENGTH.get(text[at : at + 2])
            ends.sort(key=lambda e: (e - at - text.count(" ", at, e) != length, -e))
        return next((e for e in ends if self._new(kind, text[at:e]) is not None), None)

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        if not _MAYBE.search(text):
            return text, {}
        found: dict[str, int] = {}
        out: list[str] = []
        done = pos = 0
        while m := _FIND.search(text, pos):
            at, kind = m.start(), m.lastgroup
            end = self._end(kind, text, at, m.end())
            if end is None:
                for kind, find in _EACH[KINDS.index(kind) + 1 :]:
                    if (other := find.match(text, at)) and (end := self._end(kind, text, at, other.end())) is not None:
                        break
            if end is None:
                pos = _GROUP.search(text, at).end()
                continue
            out += [text[done:at], self._new(kind, text[at:end])]
            found[kind] = found.get(kind, 0) + 1
            done = pos = end
        return "".join(out) + text[done:], found


def _run(key: bytes, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonymizer(key)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                out = [(None, {}) if t is None else names.replace(t) for t in part.column(1).to_pylist()]
                counts = [pa.array([f.get(kind, 0) for _, f in out], pa.int32()) for kind in KINDS] if counted else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in out], pa.string()), *counts], names=["row", "text", *(f"n_{kind}" for kind in KINDS if counted)])

    return run


def pseudonymize(docs: DataFrame, key: bytes, counted: bool = True) -> DataFrame:
    """``docs`` with its ``text`` pseudonymised and, if ``counted``, a count ``n_<kind>`` of each kind of finding.

    Whoever has the key can invert the pseudonyms.
    """
    bounded_batches(docs.sparkSession)
    counts = [f"n_{kind}" for kind in KINDS if counted]
    docs = docs.drop(*counts)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"], F.lit(0).alias(unused(docs, "filler"))).alias("row"), "text")
    out = packed.mapInArrow(_run(key, counted), StructType([packed.schema["row"], StructField("text", StringType()), *(StructField(c, IntegerType()) for c in counts)]))
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns], *counts)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
