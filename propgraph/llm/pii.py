"""Personal data replaced by keyed surrogates.

Detection finds e-mail addresses, phone and card numbers, social security numbers, IBANs, IP
addresses, access keys, assigned secrets and names: after a title, or a known given name before a
capitalised word; within a text, further mentions of a name or of its last part count as well. Each
finding has a canonical form, so spellings of the same entity (case, separators) are one entity
everywhere.

A surrogate comes from a keyed permutation of the strings of one format: every character moves
within its class (digit, lower or upper vowel or consonant of its script) by an unbalanced Feistel
network whose rounds are keyed hashes. Equal entities get equal surrogates in every document, and
different entities of a format different ones. A name is replaced part by part, so a surname alone
and the full name stay tied; known given names move within their gender and script, whatever the
title. Cards keep issuer digit and a valid check digit, addresses stay public or private.

Collision check: surrogates are distinct over all kinds together, and none is an entity that the
corpus holds or a known given name. Entities whose first surrogate breaks this are found by one
aggregate over all distinct strings. They try further keys, then longer strings of the same make
(IPv4 addresses: unique local IPv6 ones), until every one has a string of its own; formats that the
corpus fills are thus left for wider ones, and no entity is given up. Few ever need it, so up to
``INLINE`` of them travel with the code, and beyond that a join brings each text its own.

Null and empty text stay as they are, other rows keep everything but the entities. Repeated rows
change alike; null ids and names of other columns do not matter, but ``spans`` may not name a column
that exists. An empty table gives no rows. Time and memory for a text are linear in its length. The key is
a parameter; the same key and corpus give the same surrogates.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean

KEY = b"propgraph surrogate key"
INLINE = 20_000
ROUNDS = 8
#: Keys that a colliding entity tries within its format before it tries longer strings.
PLAIN_TRIES = 12
#: Parts among which the rows of one text are dealt where a join brings surrogates.
SALTS = 16

# Given names by script and gender, and titles with the gender they tell.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carla Carmen Clara Diana Elena Emma Eva Hannah Helen Ines Julia Laura Linda Lucia Marie Maria Nadia Nina Olivia Paula Sarah Sofia Susan".split(),
    ("latin", "m"): "Adam Alan Anton Carlos David Diego Erik Felix Frank George Hans Henry Hugo Ivan James Jan John Juan Karl Louis Marc Martin Michael Oscar Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Mme Madame Mlle Sra Señora Srta Doña госпожа Госпожа".split(),
    "m": "Mr Herr Monsieur Sr Señor Don господин Господин".split(),
    "": "Dr Prof".split(),
}
# Classes of characters that surrogates keep.
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "ßæøœđłðþ", "ÆØŒĐŁÐÞ")
LOCAL = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ._%+-")
# Words before dotted numbers that are no addresses.
VERSIONS = ("version", "release", "ver.", "ver", "v.", "v")

# Reserved blocks of addresses.
RESERVED = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()

BLOCKS = [(int(b.network_address), 32 - b.prefixlen) for b in map(ipaddress.ip_network, RESERVED)]
GIVEN_OF = {n: own for own in GIVEN.values() for n in own}
CLASS = {c: (a, a.index(c)) for a in ALPHABETS for c in a}
WORDCHARS = "0-9A-Za-z"

_NUMBER = re.compile(
    rf"(?P<ipv4>(?<![\w.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?![\w]|\.\d))"
    rf"|(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))"
    rf"|(?P<card>(?<![\w.+-])[3-6]\d{{3}}(?:[ -]?\d{{4}}){{2}}[ -]?\d{{1,7}}(?![\w-]))"
    # phone numbers: international; with an area code in brackets; 3-3-4 digits between equal marks; with a leading 0
    rf"|(?P<phone>(?<![\w.])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}"
    rf"|\(\d{{2,5}}\)[ .-]?\d{{3,4}}[ .-]\d{{3,4}}|(?:1[ .-])?\d{{3}}(?P<mark>[ .-])\d{{3}}(?P=mark)\d{{4}}|0\d{{1,4}}[ .-]\d{{3,4}}[ .-]\d{{3,5}})(?!\w|[.-]\d))"
)
_DOMAIN = re.compile(r"[0-9A-Za-z](?:[0-9A-Za-z\-]*[0-9A-Za-z])?(?:\.[0-9A-Za-z](?:[0-9A-Za-z\-]*[0-9A-Za-z])?)*\.[A-Za-z]{2,24}(?![0-9A-Za-z])")
_NAMED = re.compile(r"(?:password|passwd|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|auth)[\"']?\s{0,3}\Z", re.I)
_VALUE = re.compile(r"\s{0,3}(\"[^\"\n]{6,}\"|'[^'\n]{6,}'|[^\s\"',;]{6,})")
_ACCESS = re.compile(rf"(?<![{WORDCHARS}])(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![{WORDCHARS}])")
_IBAN = re.compile(rf"(?<![{WORDCHARS}])[A-Z]{{2}}\d{{2}}(?: ?[0-9A-Z]{{4}}){{3,7}}(?: ?[0-9A-Z]{{1,3}})?(?![{WORDCHARS}])")
_TITLED = re.compile(r"([MHFSDPгГ][a-zñéа-я]{1,9})(?=\.? ((?:[A-ZА-ЯÀ-Þ][a-zа-яß-ÿ]+(?:[-'][A-ZА-ЯÀ-Þ][a-zа-яß-ÿ]+)?)(?: [A-ZА-ЯÀ-Þ][a-zа-яß-ÿ]+(?:[-'][A-ZА-ЯÀ-Þ][a-zа-яß-ÿ]+)?)?))")
_SURNAME = r"[A-ZА-ЯÀ-Þ][a-zа-яß-ÿ]+(?:[-'][A-ZА-ЯÀ-Þ][a-zа-яß-ÿ]+)?"
#: Starts with a capital, so most text is passed over fast; whether the first word is a given name is looked up.
_UNTITLED = re.compile(rf"([A-ZА-Я][a-zа-я]{{1,9}})(?= ({_SURNAME})(?!\w))")
_GENDER_OF = {n: g for (_, g), own in GIVEN.items() for n in own}
_GENDER = {t: g for g, own in TITLES.items() for t in own}
_IBAN_START = re.compile(r"[A-Z]{2}\d{2}")
#: Stretches in which numbers can lie; they start with one of few characters, so most text is passed over fast.
_DIGITS = re.compile(r"[+(\d][\d .()+\-]{4,}")

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(text: str, a: int, b: int) -> int:
    """Where the IBAN that starts at ``a`` ends, ``b`` at the furthest; 0 if there is none."""
    while b - a >= 15:
        if text[b - 1] != " " and _iban_ok(text[a:b]) and not text[b : b + 1].isalnum():
            return b
        b -= 1
    return 0


def _special(address: str) -> bool:
    """Addresses of no one: any host, this host, broadcast."""
    return address in ("0.0.0.0", "127.0.0.1", "255.255.255.255")


def find(text: str) -> list[Span]:
    """Entities of a text as (start, end, kind), in order, none overlapping."""
    found: list[tuple[int, int, int, str]] = []
    after, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > after and text[left - 1] in LOCAL:
            left -= 1
        while left < at and text[left] in ".-+":
            left += 1
        if left < at and (right := _DOMAIN.match(text, at + 1)):
            found.append((0, left, right.end(), "email"))
        after = at + 1
        at = text.find("@", after)
    for mark in ("=", ":"):
        at = text.find(mark)
        while at >= 0:
            if _NAMED.search(text, max(0, at - 40), at) and (m := _VALUE.match(text, at + 1)):
                a, b = m.span(1)
                if text[a] in "\"'":
                    a, b = a + 1, b - 1
                elif text[b - 1] in ".!?)":
                    b -= 1
                found.append((1, a, b, "secret"))
            at = text.find(mark, at + 1)
    if "AKIA" in text or "ASIA" in text:
        found += [(2, *m.span(), "access_key") for m in _ACCESS.finditer(text)]
    for run in _DIGITS.finditer(text):
        for m in _NUMBER.finditer(text, run.start(), min(len(text), run.end() + 2)):
            kind = next(k for k in ("ipv4", "ssn", "card", "phone") if m[k])
            digits = re.sub(r"\D", "", m[0])
            if kind == "ipv4":
                good = all(int(x) < 256 for x in m[0].split(".")) and not _special(m[0]) and not text[max(0, m.start() - 9) : m.start()].rstrip().lower().endswith(VERSIONS)
            elif kind == "card":
                good = _luhn(digits)
            else:
                good = kind != "phone" or 8 <= len(digits) <= 15
            if good:
                found.append((4, *m.span(), kind))
    if _IBAN_START.search(text):
        found += [(3, m.start(), end, "iban") for m in _IBAN.finditer(text) if (end := _iban_end(text, *m.span()))]
    names = []
    for m in _TITLED.finditer(text):
        if m[1] in _GENDER and not (m.start() and text[m.start() - 1].isalnum()):
            names.append((5, *m.span(2), "name_" + _GENDER[m[1]]))
    for m in _UNTITLED.finditer(text):
        if m[1] in _GENDER_OF and not (m.start() and text[m.start() - 1].isalnum()):
            names.append((6, m.start(), m.end(2), "name_" + _GENDER_OF[m[1]]))
    if names:
        mentions: dict[str, str] = {}
        for _, a, b, kind in names:
            mentions.setdefault(text[a:b], kind)
            last = text[a:b].rpartition(" ")[2]
            if len(last) > 2:
                mentions.setdefault(last, kind)
        again = re.compile("(?<!\\w)(?:" + "|".join(map(re.escape, sorted(mentions, key=lambda n: (-len(n), n)))) + ")(?!\\w)")
        names += [(7, *m.span(), mentions[m[0]]) for m in again.finditer(text)]
    found += names
    found.sort(key=lambda x: (x[1], x[0], -x[2]))
    out: list[Span] = []
    taken: list[tuple[int, int, int, str]] = []
    for f in found:
        if taken and f[1] < taken[-1][2]:
            if f[0] < taken[-1][0] and f[2] >= taken[-1][2]:
                taken[-1] = f
            continue
        taken.append(f)
    for _, a, b, kind in taken:
        if b > a:
            out.append((a, b, kind))
    return out


def canonical(kind: str, s: str) -> str:
    if kind == "email":
        return s.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", s)
    if kind == "phone":
        digits = re.sub(r"\D", "", s)
        return "+" + digits if s.lstrip().startswith("+") else digits
    if kind == "iban":
        return s.replace(" ", "")
    if kind == "ipv4":
        return ".".join(str(int(x)) for x in s.split("."))
    if kind.startswith("name"):
        return unicodedata.normalize("NFC", s)
    return s


def _permute(key: bytes, kind: str, s: str, free: list[int], classes: dict[int, str] | None = None) -> str:
    """A keyed permutation of the strings that agree with ``s`` in classes, and outside ``free``.

    ``classes`` names other alphabets for some places.
    """
    classes = classes or {}
    places = [i for i in free if i in classes or s[i] in CLASS]
    if not places:
        return s
    alphabets = [classes.get(i) or CLASS[s[i]][0] for i in places]
    values = [a.index(s[i]) for i, a in zip(places, alphabets)]
    marks = dict(zip(places, alphabets))
    form = "".join(f"{marks[i][0]}{len(marks[i])}" if i in marks else c for i, c in enumerate(s))
    half = len(places) // 2
    for r in range(ROUNDS):
        mine, other = (range(half), range(half, len(places))) if r % 2 else (range(half, len(places)), range(half))
        seed = f"{kind}|{r}|{form}|{','.join(str(values[i]) for i in other)}".encode()
        stream = b"".join(hashlib.blake2b(seed, key=key[:64], salt=k.to_bytes(8, "big")).digest() for k in range(-(-2 * len(places) // 64)))
        for n, i in enumerate(mine):
            values[i] = (values[i] + int.from_bytes(stream[2 * n : 2 * n + 2], "big")) % len(alphabets[i])
    out = list(s)
    for i, alphabet, v in zip(places, alphabets, values):
        out[i] = alphabet[v]
    return "".join(out)


def _ip_class(n: int) -> int:
    """The reserved block that holds an address; -1 for public ones."""
    return next((i for i, (first, bits) in enumerate(BLOCKS) if n >> bits == first >> bits), -1)


def _ip(key: bytes, s: str) -> str:
    """A permutation of the addresses of one reserved block, or of all public ones."""
    if _special(s):
        return s
    n = int(ipaddress.IPv4Address(s))
    own = _ip_class(n)
    first, bits = BLOCKS[own] if own >= 0 else (0, 32)
    low_bits = bits // 2
    while True:
        high, low = (n - first) >> low_bits, n & ((1 << low_bits) - 1)
        for r in range(ROUNDS):
            mine, width = (low, bits - low_bits) if r % 2 else (high, low_bits)
            f = int.from_bytes(hashlib.blake2b(f"ipv4|{own}|{r}|{mine}".encode(), key=key[:64], digest_size=4).digest(), "big") & ((1 << width) - 1)
            high, low = (high ^ f, low) if r % 2 else (high, low ^ f)
        n = first + (high << low_bits | low)
        if _ip_class(n) == own and not _special(value := str(ipaddress.IPv4Address(n))):
            return value


def units(kind: str, c: str) -> list[tuple[str, str]]:
    """What of a canonical entity gets a surrogate of its own: a name's parts but a known given name before others, else the whole."""
    if not kind.startswith("name"):
        return [(kind, c)]
    parts = c.split(" ")
    return [("name", p) for p in (parts[1:] if len(parts) > 1 and parts[0] in GIVEN_OF else parts)]


_orders: dict[tuple[bytes, str], str] = {}


def given(key: bytes, name: str) -> str:
    """The next of the given names of the same gender and script, in an order of the key's."""
    if (key, name) not in _orders:
        own = sorted(GIVEN_OF[name], key=lambda n: hashlib.blake2b(n.encode(), key=key[:64]).digest())
        _orders.update({(key, n): own[(i + 1) % len(own)] for i, n in enumerate(own)})
    return _orders[key, name]


def _hex(s: str) -> bool:
    return set(s) <= set("0123456789abcdef") and not s.isdigit() and not s.isalpha()


def _card(inner: str) -> str:
    return next(v for d in "0123456789" if _luhn(v := inner + d))


def _iban(inner: str) -> str:
    """Country, any two digits and an account number with the right two digits."""
    rest = int("".join(str(int(x, 36)) for x in inner[4:] + inner[:2] + "00")) % 97
    return f"{inner[:2]}{98 - rest:02d}{inner[4:]}"


def step(key: bytes, kind: str, c: str, base: bytes | None = None) -> str:
    """The canonical surrogate of a unit: one step of its kind's permutation. ``base``: the key of e-mail domains, if another."""
    if kind == "ipv4":
        return _ip(key, c)
    if kind == "name":
        plain = unicodedata.normalize("NFD", c)
        return unicodedata.normalize("NFC", _permute(key, "name", plain, list(range(len(plain)))))
    every = list(range(len(c)))
    if kind == "email":
        at, dot = c.index("@"), c.rindex(".")
        local = _permute(key, "local", c, every[:at])
        domain = _permute(base or key, "domain", c[at:], list(range(1, dot - at)))  # one surrogate for a domain, whoever writes from it
        return local[:at] + domain
    if kind == "card":
        return _card(_permute(key, kind, c, every[1:-1])[:-1])
    if kind == "phone":
        area = len(c) - 10 if c.startswith("+") and len(c) > 10 else int(c.startswith("+"))
        return _permute(key, kind, c, every[area:], {area: "23456789"} if c[area] in "23456789" else {})
    if kind == "secret" and _hex(c):
        value = c
        while True:
            value = _permute(key, "hex", value, every, dict.fromkeys(every, "0123456789abcdef"))
            if _hex(value):
                return value
    if kind == "iban":
        return _iban(_permute(key, kind, c, every[4:]))
    if kind == "access_key":
        return _permute(key, kind, c, every[4:])
    return _permute(key, kind, c, every)


def wider(key: bytes, kind: str, c: str, more: int, base: bytes | None = None) -> str:
    """A longer surrogate: keyed random characters, ``more`` of them beyond the length of the unit."""
    seed = f"wider|{kind}|{c}".encode()
    stream = b"".join(hashlib.blake2b(seed, key=key[:64], salt=k.to_bytes(8, "big")).digest() for k in range(1 + (len(c) + more) // 32))
    number = iter(int.from_bytes(stream[i : i + 2], "big") for i in range(0, len(stream), 2))

    def drawn(n: int, alphabet: str) -> str:
        return "".join(alphabet[next(number) % len(alphabet)] for _ in range(n))

    if kind == "ipv4":
        digits = "fd" + drawn(30, "0123456789abcdef")
        return str(ipaddress.IPv6Address(int(digits, 16)))
    if kind == "name":
        cyrillic = any("а" <= x.lower() <= "я" for x in c)
        vowels, consonants = ALPHABETS[5:7] if cyrillic else ALPHABETS[1:3]
        whole = "".join((consonants if i % 2 else vowels)[next(number) % 5] for i in range(len(c) + more))
        return whole.capitalize()
    moved = step(key, kind, c, base)
    if kind == "email":
        local, domain = moved.split("@")
        return f"{local}{drawn(more, ALPHABETS[1] + ALPHABETS[2])}@{domain}"
    if kind == "card":
        return _card(moved[:-1] + drawn(more, ALPHABETS[0]))
    if kind == "iban":
        return _iban(moved + drawn(more, ALPHABETS[0]))
    if kind == "access_key":
        return moved + drawn(more, ALPHABETS[3] + ALPHABETS[4])
    return moved + drawn(more, "0123456789abcdef" if kind == "secret" else ALPHABETS[0])


def shaped(kind: str, original: str, surrogate: str) -> str:
    """The surrogate in the original's spelling: its separators, its case; what is longer follows."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(surrogate.lstrip("+"))
        plain = str.isdigit if kind != "iban" else str.isalnum
        return "".join([next(rest) if plain(c) else c for c in original] + list(rest))
    if kind == "email":
        at, new = original.index("@"), surrogate.index("@")
        spelt = [s.upper() if c.isupper() else s for c, s in zip(original[:at], surrogate)] + [surrogate[at:new]]
        return "".join(spelt + [s.upper() if c.isupper() else s for c, s in zip(original[at:], surrogate[new:])])
    return surrogate


class Rewriter:
    def __init__(self, key: bytes, moved: dict[tuple[str, str], str] | None = None):
        self.key, self.moved = key, moved or {}
        self.known: dict[tuple[str, str], str] = {}

    def unit(self, kind: str, c: str, own: dict[tuple[str, str], str]) -> str:
        if s := own.get((kind, c)) or self.moved.get((kind, c)):
            return s
        if (kind, c) not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[kind, c] = step(self.key, kind, c)
        return self.known[kind, c]

    def surrogate(self, kind: str, c: str, own: dict[tuple[str, str], str]) -> str:
        parts = [self.unit(*u, own) for u in units(kind, c)]
        first, rest, _ = c.partition(" ")
        if kind.startswith("name") and rest and first in GIVEN_OF:
            parts.insert(0, given(self.key, first))
        return " ".join(parts)

    def __call__(self, text: str, own: dict[tuple[str, str], str] | None = None) -> tuple[str, list[dict]]:
        out, spans, at = [], [], 0
        for a, b, kind in find(text):
            original = text[a:b]
            out += [text[at:a], shaped(kind, original, self.surrogate(kind, canonical(kind, original), own or {}))]
            spans.append({"kind": kind.rstrip("_"), "start": a, "end": b})
            at = b
        return ("".join([*out, text[at:]]) if spans else text), spans


def entities(docs: DataFrame, key: bytes = KEY, text: str = "text") -> DataFrame:
    """``body, kind, entity, surrogate``: each unit of each text (body: hash of the text), once, with its first surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                own = {u for a, b, kind in find(t) for u in units(kind, canonical(kind, t[a:b]))} if t else ()
                rows += [(body, kind, c, step(key, kind, c)) for kind, c in sorted(own)]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["body", "kind", "entity", "surrogate"])

    return docs.select(F.xxhash64(text).alias("body"), text).mapInArrow(lean(run), "body long, kind string, entity string, surrogate string")


def collisions(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """``kind, entity, surrogate`` of units that may not keep their first surrogate.

    Open is a unit whose surrogate equals any unit of the corpus or a known given name, and of units
    with one surrogate all but the least. Open ones try one further string after another, each round a
    new key, from round ``PLAIN_TRIES`` on a longer string. A try counts if nothing real and nothing
    given so far equals it; of units that try the same string the least has it. It ends when none is
    open: strings grow by a character a round, so room always comes.
    """
    spark = found.sparkSession
    distinct = cut(found.select("kind", "entity", "surrogate").distinct())
    known = spark.createDataFrame([(n,) for n in GIVEN_OF], "s string")
    holder = F.struct("kind", "entity")
    none = F.lit(None).cast("struct<kind: string, entity: string>")
    real = distinct.select(F.col("entity").alias("s")).unionByName(known)
    meet = distinct.select(F.col("surrogate").alias("s"), holder.alias("who")).unionByName(real.withColumn("who", none))
    groups = meet.groupBy("s").agg(F.max(F.col("who").isNull()).alias("real"), F.array_sort(F.collect_list("who")).alias("all"))
    losers = F.when(F.col("real"), F.col("all")).otherwise(F.slice("all", F.lit(2), F.greatest(F.size("all"), F.lit(1))))
    open_ = cut(groups.filter(F.col("real") | (F.size("all") > 1)).select(F.explode(losers).alias("who")).select("who.*"))
    settled = open_.select("kind", "entity", F.col("entity").alias("surrogate")).limit(0)
    if open_.isEmpty():
        return settled

    def tries(attempt: int):
        new = hashlib.blake2b(attempt.to_bytes(4, "big"), key=key[:64]).digest()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                tried = [step(new, kind, e, key) if attempt < PLAIN_TRIES else wider(new, kind, e, attempt + 1 - PLAIN_TRIES, key) for kind, e in pairs]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tried, pa.string())], ["kind", "entity", "surrogate"])

        return run

    given_ = distinct.select(F.col("surrogate").alias("s"))
    attempt = 0
    while not open_.isEmpty():
        tried = cut(open_.mapInArrow(tries(attempt), "kind string, entity string, surrogate string"))
        hits = real.unionByName(given_).join(tried.select(F.col("surrogate").alias("s")).distinct(), "s", "left_semi")
        free = tried.join(hits, F.col("surrogate") == F.col("s"), "left_anti")
        won = cut(free.groupBy("surrogate").agg(F.min(holder).alias("who")).select("who.kind", "who.entity", "surrogate"))
        settled = settled.unionByName(won)
        given_ = given_.unionByName(won.select(F.col("surrogate").alias("s")))
        open_ = cut(open_.join(won, ["kind", "entity"], "left_anti"))
        attempt += 1
    return settled


def replace(docs: DataFrame, key: bytes = KEY, text: str = "text", spans: str | None = None, inline: int = INLINE) -> DataFrame:
    """``docs`` with entities in ``text`` replaced; with ``spans``, a column of that name lists what was found (code points of the original)."""
    if spans in docs.columns:
        raise ValueError(f"there is a column {spans} already")
    found = cut(entities(docs, key, text))
    moved = cut(collisions(found, key))
    few = moved.count() <= inline
    table = {(r["kind"], r["entity"]): r["surrogate"] for r in moved.collect()} if few else {}
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    place = names.index(text)
    if not few:  # copies of one text, and texts that are null, are dealt among the salts
        own = found.select("body", "kind", "entity").distinct().join(moved.withColumnRenamed("surrogate", "s"), ["kind", "entity"])
        own = own.groupBy("body").agg(F.collect_list(F.struct("kind", "entity", "s")).alias("own"))
        own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("body", F.xxhash64(f"c{place}")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        rows = rows.join(own, ["body", "salt"], "left").drop("body", "salt")
    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)])
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")))
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(key, table)
        for batch in batches:
            new, marks = [], []
            extra = batch.column(len(names)) if not few else None
            for i, t in enumerate(batch.column(place)):
                t = t.as_py()
                own = {(x["kind"], x["entity"]): x["s"] for x in extra[i].as_py() or ()} if extra is not None else None
                n, m = rewrite(t, own) if t else (t, [])
                new.append(n)
                marks.append(m)
            columns = [batch.column(i) for i in range(len(names))]
            columns[place] = pa.array(new, batch.column(place).type)
            labels = [f"c{i}" for i in range(len(names))]
            if spans:
                columns.append(pa.array(marks, kind_of))
                labels.append("spans")
            yield pa.RecordBatch.from_arrays(columns, labels)

    out = rows.mapInArrow(lean(run), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *([F.col("spans").alias(spans)] if spans else []))
