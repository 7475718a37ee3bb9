"""Format-preserving pseudonyms for personal data: validated values are keyed-permuted within their format.

A value is read as a number below the size of its format (for a card 10 ** (digits - 1), for a date the days of the
valid range, for an e-mail's local part letters and digits in their places), permuted by a keyed Feistel network on
that range, and written back in the same shape. A value that may be written in several ways has one number: a date its
day, whichever order or name of the month it is written with; a phone its country code, which stays, and the digits
behind it (ten digits without a code are +1); an IPv6 address its 128 bits. So such values stay linked as well. The permutation is a bijection, so equal values get equal pseudonyms in
every document and different ones stay apart; punctuation, case and check digits are kept or made right again. Numbers
that fail their check (Luhn, octets, calendar, mod 97) are left alone.

A card or IBAN may have numbers or words next to it that read as part of it. Every span of whole groups that could be
one is checked, usual groupings first; where none is right, the search goes on at the next group. If a pseudonym would
make one of the spans right that were checked before and failed, it is permuted again, so that the inverse finds the same
span; such a value's pseudonym depends on its neighbours.

The inverse gives back the text but for what the spelling doesn't say: leading zeros of one-digit days and months next to
others without, which of two languages the name of a month was in if the pseudonym's is in both, whether it was short where
the pseudonym's is both, "Sept" and "1er", and how an IPv6 address was spelt. Dates with two-digit years are linked among
themselves, as only a hundred years can be told apart; so are phone numbers as they are dialled within a country. A domain of
an e-mail address stays, and so do ten digits without a separator, which may be any number. A card's groups have two digits
at least.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import hmac
import ipaddress
import math
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ROUNDS = 8
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
#: Names of months by language, whole and short. Fixed values.
MONTHS = {
    "en": ("January February March April May June July August September October November December", "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"),
    "fr": ("janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "janv févr mars avr mai juin juil août sept oct nov déc"),
    "de": ("Januar Februar März April Mai Juni Juli August September Oktober November Dezember", "Jan Feb Mär Apr Mai Jun Jul Aug Sep Okt Nov Dez"),
    "es": ("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "ene feb mar abr may jun jul ago sep oct nov dic"),
}
MONTHS = {k: tuple(x.split() for x in v) for k, v in MONTHS.items()}
#: By a name in lower case: what it may be, as (language, month, whether it is the short form), the likely first.
NAMED: dict[str, list[tuple[str, int, bool]]] = {"sept": [("en", 9, True)]}
for _language, _forms in MONTHS.items():
    for _short, _names in zip((False, True), _forms, strict=True):
        for _i, _name in enumerate(_names, 1):
            NAMED.setdefault(_name.lower(), []).append((_language, _i, _short))
MONTH = "(?:" + "|".join(sorted({f(n) for n in NAMED for f in (str.lower, str.upper, str.title)}, key=lambda n: (-len(n), n))) + ")"
#: Two-digit years from it on are of the 20th century.
PIVOT = 30
#: Country calling codes of one and two digits; all others have three.
CALLING = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: Patterns by kind; an earlier kind wins where two begin at the same place.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "token": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}|xox[abeoprs]-[0-9A-Za-z-]{10,200}|eyJ[0-9A-Za-z_-]{8,2000}\.eyJ[0-9A-Za-z_-]{8,4000}\.[0-9A-Za-z_-]{8,1000})(?![0-9A-Za-z])",
    "password": r"(?<![0-9A-Za-z])(?:[Pp]assword|[Pp]asswd|[Pp]asswort|PASSWORD|pwd|[Cc]ontraseña|[Mm]ot de passe)[ ]?[:=][ ]?(?=[^\s\"']*[0-9])(?=[^\s\"']*[A-Za-z])[^\s\"',;]{6,64}",
    "iban": r"(?<![0-9A-Za-z])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|LOWER[0-9]{2}(?: ?[a-z0-9]){11,30})(?![0-9A-Za-z])",
    "phone": r"(?<![\d+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![\d+])\+[0-9]{1,3} ?\(0\) ?[0-9]{2,4}(?:[ .-]?[0-9]{2,8}){1,3}(?![0-9])|(?<![\w.+/-])0[1-9](?:[ .-][0-9]{2}){4}(?![\d.-])|(?<![\w.+/-])0[1-9][0-9]{1,3}[ /-][0-9]{6,8}(?![\d./-])|(?<![\d(])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])",
    "date": r"(?<![\d/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{2})(?![\d/-]|\.[0-9])"
    + f"|(?<![\\w.-])[0-9]{{1,2}}(?:st|nd|rd|th|er|\\.)? (?:de )?{MONTH}\\.?,?(?: del?)? [0-9]{{4}}(?![\\w-])|(?<![\\w.-]){MONTH}\\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}(?![\\w-])",
    "ssn": r"(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-])",
    "ip": r"(?<![\d.vV])(?<!ersion )[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:)){1,7}:?(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])",
    "card": r"(?<![\d.])(?![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Characters of an IBAN by country.
IBAN_SIZE = {c[:2]: int(c[2:]) for c in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30".split()}
PATTERNS["iban"] = PATTERNS["iban"].replace("LOWER", "(?:" + "|".join(sorted(IBAN_SIZE)).lower() + ")")
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()), re.ASCII)
HINT = re.compile("[0-9@:]|AKIA|gh[opsu]_|sk-|xox|eyJ")
#: Usual digits of a card's groups.
GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), *((n,) for n in range(13, 20))}


class Permutation:
    """A keyed bijection of 0..n-1 for any n: Feistel on two halves by modular addition, walked until it is in range."""

    def __init__(self, key: bytes):
        self.key = key

    def part(self, tweak: str, n: int, i: int, x: int, below: int) -> int:
        said = f"{tweak}|{n}|{i}|{x}".encode()
        return int.from_bytes(hmac.digest(self.key, said, "sha256"), "big") % below

    def once(self, tweak: str, n: int, x: int) -> int:
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)  # left < a, right < b
        for i in range(0, ROUNDS, 2):
            left = (left + self.part(tweak, n, i, right, a)) % a
            right = (right + self.part(tweak, n, i + 1, left, b)) % b
        return left * b + right

    def back(self, tweak: str, n: int, x: int) -> int:
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for i in reversed(range(0, ROUNDS, 2)):
            right = (right - self.part(tweak, n, i + 1, left, b)) % b
            left = (left - self.part(tweak, n, i, right, a)) % a
        return left * b + right

    def __call__(self, tweak: str, n: int, x: int, inverse: bool = False) -> int:
        if n < 2:
            return x
        step = self.back if inverse else self.once
        x = step(tweak, n, x)
        while x >= n:
            x = step(tweak, n, x)
        return x


def fill(shape: str, chars: Iterable[str], keep: Callable[[str], bool]) -> str:
    """The shape with its characters replaced in order, those to keep and letter case left as they were."""
    it = iter(chars)
    return "".join(c if keep(c) else (lambda x: x.upper() if c.isupper() else x)(next(it)) for c in shape)


def digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def luhn(s: str) -> int:
    """0 for a number with a right check digit."""
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def mixed(chars: str, alphabets: list[str], p: Permutation, tweak: str, inverse: bool) -> str:
    """Permutes a string whose i-th character is one of alphabets[i]."""
    n = math.prod(map(len, alphabets))
    x = 0
    for c, a in zip(chars, alphabets, strict=True):
        x = x * len(a) + a.index(c)
    x = p(tweak, n, x, inverse)
    out = []
    for a in reversed(alphabets):
        x, r = divmod(x, len(a))
        out.append(a[r])
    return "".join(reversed(out))


def card(s: str, p: Permutation, inverse: bool) -> str | None:
    d = digits(s)
    if luhn(d) or len(set(d)) == 1:
        return None
    body = mixed(d[:-1], [DIGITS] * (len(d) - 1), p, "card", inverse)
    return fill(s, body + str(-luhn(body + "0") % 10), lambda c: c not in DIGITS)


def iban(s: str, p: Permutation, inverse: bool) -> str | None:
    flat = s.replace(" ", "")
    value = lambda t: int("".join(str(int(c, 36)) for c in t))
    if value(flat[4:] + flat[:4]) % 97 != 1:
        return None
    country = flat[:2].upper()
    body = mixed(flat[4:].lower(), [DIGITS if c in DIGITS else LETTERS for c in flat[4:]], p, "iban" + country, inverse)
    check = 98 - value(body + country + "00") % 97
    return fill(s, country.lower() + f"{check:02d}" + body, lambda c: c == " ")


def phone(s: str, p: Permutation, inverse: bool) -> str | None:
    d = digits(s)
    if not 7 <= len(d) <= 15:
        return None
    code = next((d[:n] for n in (1, 2) if d[:n] in CALLING), d[:3]) if s[0] == "+" else ""
    if "(0)" in s or not code and d[0] == "0":  # what is dialled before a number within its country stays
        head = s[: s.index("0") + 1] if not code else s[: s.index("(0)") + 3]
        body = digits(s[len(head) :])
        return head + fill(s[len(head) :], mixed(body, [DIGITS] * len(body), p, "phone" + (code or "0"), inverse), lambda c: c not in DIGITS)
    body = d[len(code) :]
    if not body:
        return None
    return fill(s, code + mixed(body, [DIGITS] * len(body), p, "phone" + (code or "1"), inverse), lambda c: c not in DIGITS)


@functools.cache
def days() -> tuple[list[int], list[int]]:
    """Ordinals of the valid days: up to the 12th of a month, and later ones."""
    every = [datetime.date.fromordinal(i) for i in range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1)]
    return [x.toordinal() for x in every if x.day <= 12], [x.toordinal() for x in every if x.day > 12]


def moved(day: datetime.date, p: Permutation, inverse: bool) -> datetime.date:
    """Days above 12 stay above: a date that can only be read month first, or day first, goes on reading so."""
    some = days()[day.day > 12]
    return datetime.date.fromordinal(some[p(f"date{day.day > 12}", len(some), bisect.bisect_left(some, day.toordinal()), inverse)])


def century(year: int) -> int:
    return year + (1900 if year >= PIVOT else 2000)


def ordinal(day: int, said: str) -> str:
    """What follows the number of a day, as it is said now."""
    if said in ("st", "nd", "rd", "th"):
        return {1: "st", 2: "nd", 3: "rd"}.get(day % 10 if day // 10 != 1 else 0, "th")
    return ("er" if day == 1 else "") if said == "er" else said


def written_date(s: str, p: Permutation, inverse: bool) -> str | None:
    """A date with the name of its month. Its language is that of its points and particles, or else of the name."""
    m = re.fullmatch(rf"(?:(?P<d1>\d+)(?P<th1>[a-z.]*) (?P<de>(?:de )?)(?P<m1>{MONTH})|(?P<m2>{MONTH})(?P<pt>\.?) (?P<d2>\d+)(?P<th2>[a-z]*))(?P<rest>.*? )(?P<y>\d{{4}})", s)
    name, number, th = (m["m1"] or m["m2"], m["d1"] or m["d2"], m["th1"] or m["th2"] or "")
    fits = NAMED[name.lower()]
    told = "es" if m["de"] or " de" in m["rest"] else "de" if th == "." else "en" if m["m2"] or th in ("st", "nd", "rd", "th") else "fr" if th == "er" else ""
    language, month, short = next((f for f in fits if f[0] == told), fits[0])
    # a name that is whole and short counts as short in English, as whole elsewhere
    short = short or language == "en" and len(name) == 3
    try:
        day = datetime.date(int(m["y"]), month, int(number))
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = moved(day, p, inverse)
    said = MONTHS[language][short][new.month - 1]
    said = said.upper() if name.isupper() else said.lower() if name.islower() else said[0].upper() + said[1:]
    count = f"{new.day:0{len(number) if number[0] == '0' else 1}d}{ordinal(new.day, th)}"
    first = f"{count} {m['de']}{said}" if m["m1"] else f"{said}{m['pt']} {count}"
    return f"{first}{m['rest']}{new.year:04d}"


def date(s: str, p: Permutation, inverse: bool) -> str | None:
    if re.search("[A-Za-z]", s):
        return written_date(s, p, inverse)
    parts = re.findall("[0-9]+", s)
    first, brief = len(parts[0]) == 4, len(parts[0]) < 4 and len(parts[2]) == 2
    try:
        y, m, d = map(int, parts if first else reversed(parts))
        y = century(y) if brief else y
        swap = not first and m > 12  # month first
        day = datetime.date(y, d if swap else m, m if swap else d)
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = moved(day, p, inverse)
    while brief and century(new.year % 100) != new.year:  # within the years that two digits can tell
        new = moved(new, p, inverse)
    a, b = re.findall("[-/.]", s)
    if first:
        return f"{new.year:04d}{a}{new.month:02d}{b}{new.day:02d}"
    wide = 2 if len(parts[0]) == len(parts[1]) == 2 else 1
    x, z = (new.month, new.day) if swap else (new.day, new.month)
    year = f"{new.year % 100:02d}" if brief else f"{new.year:04d}"
    return f"{x:0{wide}d}{a}{z:0{wide}d}{b}{year}"


def ssn(s: str, p: Permutation, inverse: bool) -> str | None:
    a, b, c = map(int, s.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if a not in areas or not b or not c:
        return None
    x = p("ssn", len(areas) * 99 * 9999, (areas.index(a) * 99 + b - 1) * 9999 + c - 1, inverse)
    x, c = divmod(x, 9999)
    a, b = divmod(x, 99)
    return f"{areas[a]:03d}-{b + 1:02d}-{c + 1:04d}"


def ip(s: str, p: Permutation, inverse: bool) -> str | None:
    parts = s.split(".")
    if any(int(x) > 255 or x != str(int(x)) for x in parts):
        return None
    x = p("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"), inverse)
    return ".".join(map(str, x.to_bytes(4, "big")))


def ipv6(s: str, p: Permutation, inverse: bool) -> str | None:
    try:
        x = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    if x < 1 << 64:  # the unspecified and loopback addresses and such; also "::" in code
        return None
    top = 1 << 64  # what is written stays what is read: none of the addresses left out comes out
    return str(ipaddress.IPv6Address(p("ipv6", (1 << 128) - top, x - top, inverse) + top))


def token(s: str, p: Permutation, inverse: bool) -> str | None:
    head = re.match("AKIA|gh[opsu]_|sk-|xox[abeoprs]-|eyJ", s).group()
    kept = [(m.start() - len(head), m.end() - len(head)) for m in re.finditer(r"(?<=\.)eyJ", s)]  # how the second part begins
    body = s[len(head) :]
    free = [c.isalnum() and not any(a <= i < b for a, b in kept) for i, c in enumerate(body)]
    flat = [c for c, f in zip(body, free, strict=True) if f]
    if not flat:
        return None
    new = iter(mixed("".join(flat).lower(), [DIGITS if c in DIGITS else LETTERS for c in flat], p, "token" + head, inverse))
    return head + "".join((x.upper() if c.isupper() else x) if f and (x := next(new)) else c for c, f in zip(body, free, strict=True))


def password(s: str, p: Permutation, inverse: bool) -> str | None:
    """What follows the word: letters and digits in their places."""
    at = re.search("[:=] ?", s).end()
    plain = lambda c: c.isascii() and c.isalnum()
    flat = [c for c in s[at:] if plain(c)]
    new = mixed("".join(flat).lower(), [DIGITS if c in DIGITS else LETTERS for c in flat], p, "password", inverse)
    return s[:at] + fill(s[at:], new, lambda c: not plain(c))


def email(s: str, p: Permutation, inverse: bool) -> str | None:
    local, _, domain = s.partition("@")
    flat = [c for c in local if c.isalnum()]
    if not flat:
        return None
    new = mixed("".join(flat).lower(), [DIGITS if c in DIGITS else LETTERS for c in flat], p, "email", inverse)
    return fill(local, new, lambda c: not c.isalnum()) + "@" + domain


def secret(s: str, p: Permutation, inverse: bool) -> str | None:
    if s.isdigit():
        return None
    new = mixed(s.lower(), [HEX] * len(s), p, "secret", inverse)
    return new if s.islower() else new.upper()


KINDS = {f.__name__: f for f in (email, secret, token, password, iban, phone, date, ssn, ip, ipv6, card)}


def spans(kind: str, s: str) -> list[tuple[int, int]]:
    """Parts of a match, of whole groups, that may be the value; the likely ones first."""
    if kind == "card":
        groups = [m.span() for m in re.finditer("[0-9]+", s)]
        sizes = [b - a for a, b in groups]
        some = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups) + 1) if 13 <= sum(sizes[i:j]) <= 19 and min(sizes[i:j]) > 1]
        some.sort(key=lambda x: (tuple(sizes[x[0] : x[1]]) not in GROUPS, x[0], sizes[x[0]] != 4, -x[1] if tuple(sizes[x[0] : x[1]]) not in GROUPS else x[1]))
        return [(groups[i][0], groups[j - 1][1]) for i, j in some]
    if kind == "iban":
        end = country_end(s)
        if s[0].islower():  # only of its country's length, as words are in lower case as well
            return [(0, end)] if end else []
        if end:
            return [(0, end)] if end == len(s) else [(0, end), (0, len(s))]
        ends = [m.start() for m in re.finditer(" ", s) if len(s[: m.start()].replace(" ", "")) >= 15]
        return [(0, e) for e in [len(s), *reversed(ends)]]
    return [(0, len(s))]


def country_end(s: str) -> int:
    """Where an IBAN of its country's length ends, 0 if no group ends there."""
    left = IBAN_SIZE.get(s[:2].upper(), 0)
    for i, c in enumerate(s if left else ""):
        left -= c != " "
        if not left:
            return i + 1 if s[i + 1 : i + 2] in ("", " ") else 0
    return 0


def behind(kind: str, s: str) -> int:
    """Where the search goes on after a match none of whose spans is right."""
    if kind == "iban" and (end := country_end(s)):
        return end
    m = re.search("[ -]", s) if kind in ("card", "iban") else None
    return m.end() if m else len(s)


def pseudonymise(text: str, key: bytes, inverse: bool = False) -> tuple[str, list[str]]:
    """The text with every validated value replaced, and the kinds found in order."""
    if not HINT.search(text):
        return text, []
    p, found = Permutation(key), []
    out, done, pos = [], 0, 0
    failed: list[tuple[str, int, int]] = []  # spans that reach beyond the place of the search

    def clashes(new: str, a: int, b: int) -> bool:
        """Whether a span that failed would be right with the new value."""
        for kind, x, y in failed:
            if x < b and a < y:
                there = text[min(x, a) : a] + new + text[b : max(y, b)]
                if KINDS[kind](there[x - min(x, a) : y - min(x, a)], p, inverse) is not None:
                    return True
        return False

    while m := ANY.search(text, pos):
        kind, at = m.lastgroup, m.start()
        failed = [x for x in failed if x[2] > at]
        for a, b in ((at + x, at + y) for x, y in spans(kind, m.group())):
            if (kind, a, b) in failed:
                continue
            new = KINDS[kind](text[a:b], p, inverse)
            if new is not None:
                break
            failed.append((kind, a, b))
        else:
            pos = at + behind(kind, m.group())
            continue
        while clashes(new, a, b):
            new = KINDS[kind](new, p, inverse)
        found.append(kind)
        out += [text[done:a], new]
        done = pos = b
    return "".join([*out, text[done:]]), found


def text_key(passphrase: str) -> bytes:
    return hashlib.sha256(passphrase.encode()).digest()


def replace(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """All rows and columns with the text replaced, then n_found (values replaced) and kinds (distinct, comma-joined).

    Null texts stay null and hold nothing; repeated rows are treated alike; long texts are searched whole, in time that grows
    with their length. Where values of two kinds begin at one place, the kind that is earlier in PATTERNS counts. An empty table gives an empty result. New
    columns that clash with others are found by their place, which is last. The key is the caller's secret.
    """
    ship(docs.sparkSession)
    secret_key = text_key(key)
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(None, []) if t is None else pseudonymise(t, secret_key, inverse) for t in batch.column(at).to_pylist()]
            cols = [pa.array([t for t, _ in pairs], pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            cols += [pa.array([len(f) for _, f in pairs], pa.int64()), pa.array([",".join(sorted(set(f))) for _, f in pairs], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_found", "kinds"])

    fields = [T.StructField(n, f.dataType, True) for n, f in zip(names, docs.schema.fields, strict=True)]
    schema = T.StructType([*fields, T.StructField("n_found", T.LongType()), T.StructField("kinds", T.StringType())])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, "n_found", "kinds")


def report(docs: DataFrame, key: str = "public example key") -> DataFrame:
    return replace(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
