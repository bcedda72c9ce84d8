"""Format-preserving pseudonyms by a keyed Feistel network (operator 2).

Personal numbers and dates are found, validated, and permuted inside the set of valid values of their own format: a card
number becomes another one of the same length, spacing and issuer digit with a right check digit, a date another date of the
same layout. The permutation depends on the key, the kind and the format only, so equal values get equal pseudonyms in all
documents, and whoever has the key can invert them. Nothing is looked up or shuffled; texts are changed in place.
"""
from __future__ import annotations

import calendar
import datetime
import hashlib
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, load

ROUNDS = 8
LOWER, UPPER, DIGIT, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "date", "credential")


class Feistel:
    """Keyed permutation of range(size): an alternating Feistel network on two nearly equal parts, walked until inside."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, k: int, value: int, modulus: int) -> int:
        wide = (modulus.bit_length() + 7) // 8 + 8
        data = f"{tweak}|{k}|{value}".encode()
        out, counter = b"", 0
        while len(out) < wide:
            out += hashlib.blake2b(data + bytes([counter]), key=self.key[:64], digest_size=min(64, wide)).digest()
            counter += 1
        return int.from_bytes(out[:wide], "big") % modulus

    def permuted(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """The image of ``value``; with ``back`` the value whose image it is. The image differs from the value where size > 1 allows it only by chance."""
        if size < 2:
            return value
        left = math.isqrt(size - 1) + 1
        right = -(-size // left)
        for _ in range(10_000):
            a, b = divmod(value, right)
            for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                sign = -1 if back else 1
                if k % 2 == 0:
                    a = (a + sign * self._round(tweak, k, b, left)) % left
                else:
                    b = (b + sign * self._round(tweak, k, a, right)) % right
            value = a * right + b
            if value < size:
                return value
        raise ArithmeticError("the walk did not come back into the range")

    def text(self, value: str, alphabets: list[str], tweak: str, back: bool = False) -> str:
        """Permutes strings whose k-th character is from the k-th alphabet."""
        number = size = 0
        size = 1
        for c, letters in zip(value, alphabets):
            number, size = number * len(letters) + letters.index(c), size * len(letters)
        number, out = self.permuted(number, size, tweak, back), []
        for letters in reversed(alphabets):
            number, k = divmod(number, len(letters))
            out.append(letters[k])
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Check digit to be put after ``digits``."""
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _alphabet(c: str) -> str:
    return next((a for a in (DIGIT, LOWER, UPPER) if c in a), c)


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGIT else c for c in shape)


def _digits(value: str) -> str:
    return "".join(c for c in value if c in DIGIT)


def _spelled(f: Feistel, kind: str, value: str, back: bool) -> str:
    """Letters stay letters and digits digits; other characters stay."""
    return f.text(value, [_alphabet(c) for c in value], f"{kind}|{re.sub('[a-z]', 'a', re.sub('[A-Z]', 'A', re.sub('[0-9]', '0', value)))}", back)


def _walked(step: Callable[[str], str], value: str, inside: Callable[[str], bool]) -> str:
    """Permutes the values that are ``inside``, of which ``value`` is one: steps until the image is inside too."""
    for _ in range(10_000):
        value = step(value)
        if inside(value):
            return value
    raise ArithmeticError("the walk did not come back into the set")


def _heads(value: str) -> list[str]:
    """What ends at a group of ``value`` before its last one."""
    return [value[:m.start()] for m in re.finditer(r"(?<=[A-Z0-9])[ -]", value)]


def _is_card(value: str) -> bool:
    d = _digits(value)
    return 13 <= len(d) <= 19 and luhn(d[:-1]) == int(d[-1]) and len(set(d)) > 1


def _whole_card(value: str) -> bool:
    """A card number of which no leading groups and no single group are one, so that a number beside a card is not taken for a part of it."""
    return _is_card(value) and not any(map(_is_card, _heads(value))) and not any(_is_card(g) for g in re.split("[ -]", value) if g != value)


def _card(f: Feistel, value: str, back: bool) -> str | None:
    if not _whole_card(value):
        return None

    def step(v: str) -> str:
        d = _digits(v)
        body = d[0] + f.text(d[1:-1], [DIGIT] * (len(d) - 2), f"card|{d[0]}|{len(d)}", back)
        return _refill(v, body + str(luhn(body)))
    return _walked(step, value, _whole_card)


def _ssn(f: Feistel, value: str, back: bool) -> str | None:
    area, group, serial = value.split("-")
    if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
        return None
    places = [a for a in range(1, 900) if a != 666]
    n = (places.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    n, serial_out = divmod(f.permuted(n, len(places) * 99 * 9999, "ssn", back), 9999)
    area_out, group_out = divmod(n, 99)
    return f"{places[area_out]:03d}-{group_out + 1:02d}-{serial_out + 1:04d}"


def _ip(f: Feistel, value: str, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = f.permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


# Characters of an IBAN by country.
IBAN_LENGTHS = {c: n for n, countries in {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN",
                                          25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY HU LB PL", 29: "BR", 31: "MT"}.items() for c in countries.split()}


def _number(letters: str) -> int:
    return int("".join(str(int(c, 36)) for c in letters))


def _is_iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and _number(plain[4:] + plain[:4]) % 97 == 1


def _whole_iban(value: str) -> bool:
    """An IBAN of its country's length, or one of which no leading groups are an IBAN."""
    return _is_iban(value) and (len(value.replace(" ", "")) == IBAN_LENGTHS.get(value[:2]) or not any(map(_is_iban, _heads(value))))


def _iban(f: Feistel, value: str, back: bool) -> str | None:
    if not _whole_iban(value):
        return None

    def step(v: str) -> str:
        plain = v.replace(" ", "")
        body = _spelled(f, f"iban|{plain[:2]}", plain[4:], back)
        whole = iter(f"{plain[:2]}{98 - _number(body + plain[:2] + '00') % 97:02d}{body}")
        return "".join(c if c == " " else next(whole) for c in v)
    return _walked(step, value, _whole_iban)


def _phone(f: Feistel, value: str, back: bool) -> str | None:
    d = _digits(value)
    if not 7 <= len(d) <= 15:
        return None
    code = re.match(r"\+\d{1,3}(?=[ (.-])", value)
    keep = len(_digits(code[0])) if code else 0
    return _refill(value, d[:keep] + f.text(d[keep:], [DIGIT] * (len(d) - keep), f"phone|{keep}|{len(d)}", back))


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2099, 12, 31) - datetime.date(1900, 1, 1)).days + 1


def _date(f: Feistel, value: str, back: bool) -> str | None:
    """Year-month-day, day.month.year and month/day/year (day/month/year where only that is a date) of 1900 to 2099."""
    mark = re.search(r"[-./]", value)[0]
    parts = value.split(mark)
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    elif mark == "/" and 1 <= int(parts[0]) <= 12:
        order = (2, 0, 1)
    else:
        order = (2, 1, 0)
    y, m, d = (int(parts[k]) for k in order)
    if not (1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    day_first = order == (2, 1, 0) and mark == "/"
    # a date that can only be read day first moves among such dates, so that the result is read the same way
    if day_first:
        valid = [o for o in range(_FIRST, _FIRST + _DAYS) if datetime.date.fromordinal(o).day > 12]
        new = datetime.date.fromordinal(valid[f.permuted(valid.index(datetime.date(y, m, d).toordinal()), len(valid), "date|day first", back)])
    else:
        new = datetime.date.fromordinal(_FIRST + f.permuted(datetime.date(y, m, d).toordinal() - _FIRST, _DAYS, "date", back))
    out = [""] * 3
    for k, v in zip(order, (new.year, new.month, new.day)):
        out[k] = f"{v:0{len(parts[k]) if len(parts[k]) != 1 else 2}d}"
    return mark.join(out)


def _email(f: Feistel, value: str, back: bool) -> str:
    name, _, host = value.rpartition("@")
    labels, dot, top = host.rpartition(".")
    return f"{_spelled(f, 'email', name, back)}@{_spelled(f, 'host', labels, back)}{dot}{top}"


def _credential(f: Feistel, value: str, back: bool) -> str:
    head = re.match(r"AKIA|(?:password|passwd|token|secret|api_?key)\s*[=:]\s*[\"']?", value, re.I)[0]
    rest = value[len(head):]
    if re.fullmatch("[0-9a-f]+", rest):
        return head + f.text(rest, [HEX] * len(rest), f"hex|{len(rest)}", back)
    return head + _spelled(f, "credential", rest, back)


# The written forms that are looked for; each match is then validated.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("credential", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-]{8,})"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("date", r"(?<![0-9])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])"),
)
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_EACH = {k: re.compile(p) for k, p in PATTERNS}
_GROUP_END, _GROUP_START = re.compile(r"(?<=[A-Za-z0-9])(?=[ .()-])"), re.compile(r"(?<=[ .-])[A-Za-z0-9(]")
_PLAIN_CARD = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}").fullmatch
_JOINED = ("iban", "card", "phone")                                      # kinds of several groups, whose patterns may run into what follows
_HINT = re.compile(r"[0-9@=:]")
_RULES: dict[str, Callable[[Feistel, str, bool], str | None]] = {"email": _email, "credential": _credential, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def _group_ends(kind: str, text: str, start: int, longest: int) -> list[int]:
    """Where a match of a joined kind may end, the longest first."""
    return [longest, *(e for e in reversed([m.start() for m in _GROUP_END.finditer(text, start + 1, longest)]) if e < longest and _EACH[kind].fullmatch(text, start, e))]


def _plain_cards(text: str, start: int) -> list[int]:
    """Ends of cards of the usual grouping that start here."""
    m = _EACH["card"].match(text, start)
    return [e for e in _group_ends("card", text, start, m.end()) if _PLAIN_CARD(text[start:e]) and _whole_card(text[start:e])] if m else []


def _ends(kind: str, text: str, start: int, longest: int) -> list[int]:
    """Where a value of a joined kind may end, likeliest first: at its longest match or at a group before, not inside another value.

    What decides is the form of the other values, and of cards their check digit: both outlive the permutation, so that the
    pseudonyms are read as the values were.
    """
    phone = _EACH["phone"].match(text, start) if kind == "card" else None
    if kind == "phone" and text[start] != "+":                           # of one length
        return [longest]
    if phone and phone.end() < longest:                                  # a phone and a number after it
        return []
    ends = [e for e in _group_ends(kind, text, start, longest) if kind != "card" or _is_card(text[start:e])]
    others, cards = [], []                                               # (start, end, may a value end with it) of what starts inside
    for g in (m.start() for m in _GROUP_START.finditer(text, start + 1, longest)) if ends else ():
        others += [(g, m.end(), False) for k in ("email", "credential", "ip", "date", "ssn") if (m := _EACH[k].match(text, g))]
        if kind != "iban":
            others += [(g, m.end(), kind == "phone")] if (m := _EACH["phone"].match(text, g)) else []
            cards += [(g, max(found))] if (found := _plain_cards(text, g)) else []

    def cuts_card(e: int) -> bool:
        """Whether the last card that starts before ``e`` goes on: a group before a card may complete a check digit by chance."""
        return not (kind == "card" and _PLAIN_CARD(text[start:e])) and max(((g, end) for g, end in cards if g < e), default=(0, 0))[1] > e
    uncut = [e for e in ends if not any(g < e < end for g, end, _ in others) and not cuts_card(e)]
    apart = [e for e in uncut if not any(g < e == end and not same for g, end, same in others)]
    if kind == "iban":
        apart.sort(key=lambda e: len(text[start:e].replace(" ", "")) != IBAN_LENGTHS.get(text[start:start + 2]))
    return apart + [e for e in uncut if e not in apart] if kind == "phone" else apart


def _value(text: str, start: int, feistel: Feistel, back: bool) -> tuple[str, int, str] | None:
    """Kind, end and image of the value that starts here: the first kind, and its first end, that passes its check."""
    for kind, pattern in _EACH.items():
        if m := pattern.match(text, start):
            for end in _ends(kind, text, start, m.end()) if kind in _JOINED else (m.end(),):
                new = _RULES[kind](feistel, text[start:end], back)
                if new is not None:
                    return kind, end, new
    return None


def pseudonymised(text: str | None, feistel: Feistel, back: bool = False) -> tuple[str | None, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind; what fails its check stays as it is."""
    found: dict[str, int] = {}
    if text is None or not _HINT.search(text):
        return text, found
    out, at = [], 0
    while m := _ANY.search(text, at):
        value = _value(text, m.start(), feistel, back)
        if value is None:                                                # no kind is valid here: another may start a character later
            out.append(text[at:m.start() + 1])
            at = m.start() + 1
            continue
        kind, end, new = value
        found[kind] = found.get(kind, 0) + 1
        out += [text[at:m.start()], new]
        at = end
    return "".join([*out, text[at:]]), found


def pseudonyms(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``docs`` with its column text pseudonymised and a column ``pii``, a map of kinds to counts.

    Null texts stay null with an empty map; empty texts stay empty. Every other column is kept; a column named pii is
    replaced. ``back`` inverts what the same key has done. Rows are neither moved nor lost.
    """
    feistel = Feistel(key)

    def change(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pseudonymised(t, feistel, back) for t in text], columns=["text", "pii"])
    change.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
    name = free_name("_changed", docs)
    changed = docs.withColumn(name, F.pandas_udf(change, "text string, pii map<string,long>")("text"))
    return changed.withColumn("text", F.col(name)["text"]).withColumn("pii", F.col(name)["pii"]).drop(name)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms(load(spark, sf_dir, "documents").select("doc_id", "text"), b"registered query key")
    counts = [F.coalesce(F.col("pii")[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", "text", *counts)
