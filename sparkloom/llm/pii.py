"""Private data replaced by keyed surrogates of the same type, format, script and gender.

A surrogate is the image of the entity under a keyed permutation of all strings of its format (a Feistel
network over mixed alphabets), so equal entities always get the same surrogate and different ones of a
type different ones. Given names become names of the same gender and script, surnames keep their own surrogate
with or without a given name before them. What can still clash (two persons with one surrogate, or a surrogate
that is somebody's real data in this corpus) is found by an aggregation over all entities, and drawn again until
nothing clashes. Where the strings of a format may be used up, later draws are longer than it.

Once a person is found in a text, the same name without a title and the surname alone are replaced there too.

Not detected: names without a title whose first word is not in GIVEN, in texts that do not have them with one;
phones of other national forms without + (seven digits, or ten without separators); postal addresses; dates of birth.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import ipaddress
import logging
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import documents, prefix, stash, text_batches

#: Key of the tests and of sessions that name none. It is published: whoever knows it can make the same surrogates.
KEY = "surrogate-key-1"
#: The session's setting that names the key.
SETTING = "sparkloom.surrogate.key"
#: Draws of an entity's own format; later ones are longer where the format may have few strings.
ROUNDS, MOST_DRAWS = 8, 8
WIDE_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

#: Alphabets within which characters are exchanged; all other characters stay. Fixed values.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñßšžčćś", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"]
#: Given names by gender and script. Fixed values.
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Emma", "Eva", "Helen", "Ines", "Julia", "Laura", "Lucy", "Maria", "Marta", "Nina", "Nora", "Paula", "Rosa", "Sara", "Sofia", "Teresa", "Vera"],
    ("m", "latin"): ["Adam", "Albert", "Carlos", "David", "Eric", "Felix", "Hans", "Jack", "John", "Jonas", "Karl", "Leo", "Luis", "Mark", "Oscar", "Paul", "Peter", "Robert", "Simon", "Thomas"],
    ("f", "cyrillic"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Светлана"],
    ("m", "cyrillic"): ["Алексей", "Борис", "Виктор", "Иван", "Михаил", "Олег", "Пётр", "Сергей"],
    ("f", "greek"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("m", "greek"): ["Γιώργος", "Ιωάννης", "Νίκος", "Πέτρος"],
}
#: Titles before a person's name, by gender. Fixed values.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "": ["Dr", "Prof"],
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_NAME = r"[A-ZÀ-ÖØ-ÞΑ-ΩΆ-ΏА-ЯЁ][a-zß-öø-ÿā-žα-ωά-ώа-яё'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in order of precedence where matches start together. `value` is the part replaced. Fixed values.
PATTERNS = {
    "email": r"(?<![\w.+-])(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)(?P<secret>[A-Za-z0-9_\-+/=.]{8,})",
    "token": r"(?<![0-9A-Za-z_-])(?P<token>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsru]_[0-9A-Za-z]{36}|github_pat_[0-9A-Za-z_]{22,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z]{20,}|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])",
    "hexkey": r"(?<![0-9A-Za-z])(?P<hexkey>(?=[0-9A-Fa-f]*\d)(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{32}))(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?!\d|\.\d)",
    "ipv6": r"(?<![\w:.])(?P<ipv6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)",
    "card": r"(?<![\d-])(?P<card>\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d|-\d)",
    "ssn": r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?!\d|-\d)",
    "phone": r"(?<![\w+.-])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3} \d{3} \d{4}|\d{3}\.\d{3}\.\d{4}|0\d{2,4}[ /-]\d{6,8}|0\d{2,4} \d{3,4} \d{3,4})(?!\d)",
}


def _all(numbered: dict[str, str]) -> str:
    return "|".join(numbered.values()).replace(r"\2", "(?P=sep)").replace("([ -]?)", "(?P<sep>[ -]?)")


MARKED = re.compile(_all(PATTERNS))
_TITLE = "|".join(sorted(_GENDER, key=lambda t: -len(t)))
PERSON = re.compile(rf"\b(?P<title>{_TITLE})\b\.? +(?P<name>{_NAME}(?: {_NAME})?)")
_FIRST = {n: g for (g, _), names in GIVEN.items() for n in names}
UNTITLED = re.compile(rf"\b(?=[A-ZΑ-ΩΆ-ΏА-Я])(?P<name>(?P<first>{'|'.join(_FIRST)}) (?!(?:{_TITLE})\b){_NAME})")
#: Where a name may begin, what it may be there, and what does not follow it.
WORD_START, AFTER = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-ÞΑ-ΩΆ-ΏА-ЯЁ]\w*"), re.compile(r"[\w'’]")
MENTIONS = [re.compile(p) for p in (rf"{_NAME} {_NAME}", rf"{_NAME} \w+", _NAME, r"\w+")]
_MAYBE = re.compile(r"[0-9@=:]|sk-|xox|gh[opsru]_|AIza")
#: What a well-known token begins with, which stays. Fixed values.
TOKEN_STARTS = re.compile(r"AKIA|ASIA|gh[opsru]_|github_pat_|xox[abprs]-|sk-|AIza")


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is private, in order and without overlaps. Persons are `name_f`, `name_m` or `name_`."""
    found = []
    if _MAYBE.search(text):
        found = [(*m.span(m.lastgroup if m.lastgroup != "sep" else "card"), m.lastgroup if m.lastgroup != "sep" else "card") for m in MARKED.finditer(text)]
    people = [(*m.span("name"), "name_" + _GENDER[m["title"]]) for m in PERSON.finditer(text)]
    titled = [e[:2] for e in people]
    starts = [a for a, _ in titled]  # in order and without overlaps
    for m in UNTITLED.finditer(text):
        before = bisect.bisect_left(starts, m.end()) - 1
        if before < 0 or titled[before][1] <= m.start():
            people.append((*m.span("name"), "name_" + _FIRST[m["first"]]))
    if not people:
        return found
    # the same persons without a title, and their surnames alone
    kinds = {}
    for a, b, kind in people:
        kinds.setdefault(text[a:b], kind)
        kinds.setdefault(text[a:b].rpartition(" ")[2], kind)
    people += mentions(text, kinds)
    end, out = -1, []
    for e in sorted(found + people, key=lambda e: (e[0], -e[1], e[2])):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


def mentions(text: str, kinds: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) where a known name stands as whole words, longer names first. Where a word begins a name a few
    strings are looked up, so the time does not grow with the number of names."""
    out, end = [], 0
    firsts = {re.match(r"\w+", name)[0] for name in kinds}
    for m in WORD_START.finditer(text):
        if m.start() < end or m[0] not in firsts:
            continue
        ends = {x.end() for p in MENTIONS if (x := p.match(text, m.start()))}
        for e in sorted(ends, reverse=True):
            if text[m.start() : e] in kinds and not AFTER.match(text, e):
                out.append((m.start(), e, kinds[text[m.start() : e]]))
                end = e
                break
    return out


@functools.cache
def _alphabet() -> dict[str, tuple[str, int]]:
    return {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}


def _mac(key: str, *parts) -> int:
    return int.from_bytes(hmac.new(key.encode(), "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permute(value: str, key: str, tweak: str) -> str:
    """The image of a string among all of its format: each character stays in its alphabet and case."""
    table = _alphabet()
    lower = [c.lower() if len(c.lower()) == 1 else c for c in value]
    at = [i for i, c in enumerate(lower) if c in table]
    size = [len(table[lower[i]][0]) for i in at]
    digit = [table[lower[i]][1] for i in at]
    form = "".join(table[c][0][0] if c in table else c for c in lower)
    if len(at) == 1:
        digit = [(digit[0] + _mac(key, tweak, form)) % size[0]]
    half = len(at) // 2
    for r in range(ROUNDS if len(at) > 1 else 0):
        mine, other = (range(half), range(half, len(at))) if r % 2 else (range(half, len(at)), range(half))
        x = _mac(key, tweak, form, r, *(digit[i] for i in other))
        n = total = 0
        radix = 1
        for i in mine:
            n += digit[i] * radix
            radix *= size[i]
        total = (n + x + (_mac(key, r, x) << 256)) % radix
        for i in mine:
            digit[i] = total % size[i]
            total //= size[i]
    out = list(value)
    for i, d in zip(at, digit, strict=True):
        c = table[lower[i]][0][d]
        out[i] = c.upper() if value[i] != lower[i] and len(c.upper()) == 1 else c
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def mod97(text: str) -> int:
    """An account number modulo 97, letters counting from 10."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def canonical(kind: str, value: str) -> str:
    """What tells entities of a kind apart: digits of numbers (a number with + and its country's code is another than the
    same digits without), lower case of addresses, words as they are."""
    if kind in ("phone", "card", "ssn"):
        return "+" * value.startswith("+") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return _ipv6(value)
    return value.lower() if kind == "email" else value


def _ipv6(value: str) -> str:
    """The 32 hexadecimal digits of an address; of what only looks like one, its digits."""
    try:
        return f"{int(ipaddress.IPv6Address(value)):032x}"
    except ValueError:
        return value.lower()


def surrogate(kind: str, value: str, key: str = KEY, draw: int = 0, surname_draw: int = 0) -> str:
    """The replacement of an entity as written. draw: 0, or more if smaller ones clash in the corpus. The surname of a
    name of several words has a draw of its own, that of the surname alone."""
    tweak = kind if not draw else f"{kind}:{draw}"
    if draw > MOST_DRAWS and (kind in ("email", "secret", "phone", "ssn") or kind.startswith("name_")):
        return _wide(kind, value, key, draw)
    if kind.startswith("name_"):
        *first, last = value.split(" ")
        return " ".join([*(_given(w, kind, key, draw) for w in first), surrogate(kind, last, key, surname_draw) if first else _name(last, "fm", key, draw)])
    if kind == "email":
        local, _, domain = value.partition("@")
        new = permute(local.lower(), key, tweak + domain.lower())
        new = "".join(c.upper() if o != o.lower() else c for c, o in zip(new, local, strict=True))
        return f"{new}@{domain if domain.lower().endswith(('example.com', 'example.org', 'example.net')) else permute(domain.rpartition('.')[0].lower(), key, tweak) + '.' + domain.rpartition('.')[2]}"
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, value.split("."))), "big")
        while True:  # walk the cycle back into addresses with no octet that is 0 or 255
            n = _permute_bits(n, key, tweak)
            octets = n.to_bytes(4, "big")
            if all(0 < o < 255 for o in octets) or any(o in ("0", "255") for o in value.split(".")):
                return ".".join(map(str, octets))
    if kind == "ipv6":
        digits = _ipv6(value)
        if ":" not in digits:
            return str(ipaddress.IPv6Address(int(_hex(digits, key, tweak), 16)))
        return ":".join(_hex(x, key, f"{tweak}:{i}") for i, x in enumerate(digits.split(":")))
    if kind in ("phone", "card", "ssn"):
        digits = canonical(kind, value).removeprefix("+")
        keep = 1 if kind == "card" else (1 if digits[0] in "17" else 2) if value.startswith("+") else int(kind == "phone" and digits[0] == "0")  # the country code, the 0 of national forms
        if kind == "card":
            body = digits[:keep] + permute(digits[keep:-1], key, tweak + digits[:keep])
            new = body + str((luhn(body) + int(digits[-1]) - luhn(digits[:-1])) % 10)
        else:
            new = digits[:keep] + permute(digits[keep:], key, tweak + digits[:keep])
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in value)
    if kind == "token":
        start = TOKEN_STARTS.match(value)[0]
        return start + permute(value[len(start) :], key, tweak + start)
    if kind == "hexkey":
        new = _hex(value.lower(), key, tweak)
        return new.upper() if value == value.upper() else new
    if kind == "iban":
        compact = value.replace(" ", "")
        valid = mod97(compact[4:] + compact[:4]) == 1
        new = permute(compact[4 if valid else 2 :].lower(), key, tweak + compact[:2]).upper()
        new = iter(compact[:2] + (f"{98 - mod97(new + compact[:2] + '00'):02d}" if valid else "") + new)
        return "".join(c if c == " " else next(new) for c in value)
    return _hex(value, key, tweak) if re.fullmatch(r"[0-9a-f]+", value) else permute(value, key, tweak)


def _wide(kind: str, value: str, key: str, draw: int) -> str:
    """A surrogate longer than the format: characters of a keyed hash of the entity tell it from all others."""
    name = kind.startswith("name_")
    n = _mac(key, "wide", "name" if name else kind, draw, canonical(kind, value))

    def told(letters: str, length: int) -> str:
        return "".join(letters[n // len(letters) ** i % len(letters)] for i in range(length))

    latin = WIDE_LETTERS["latin"]
    if name:
        *first, last = value.split(" ")
        return " ".join([*(_given(w, kind, key, draw) for w in first), told(WIDE_LETTERS[script_of(last)], 24).capitalize()])
    if kind == "email":
        local, _, domain = value.partition("@")
        new = told(latin, 24)
        if not domain.lower().endswith(("example.com", "example.org", "example.net")):
            domain = permute(domain.rpartition(".")[0].lower(), key, f"{kind}:{draw}") + "." + domain.rpartition(".")[2]
        return f"{new.upper() if local.isupper() else new}@{domain}"
    if kind == "secret":
        return told(latin + ALPHABETS[0], 32)
    return surrogate(kind, value, key, MOST_DRAWS) + told(ALPHABETS[0], 24)


def _permute_bits(n: int, key: str, tweak: str) -> int:
    a, b = n >> 16, n & 0xFFFF
    for r in range(ROUNDS):
        a, b = b, a ^ (_mac(key, tweak, r, b) & 0xFFFF)
    return a << 16 | b


def _hex(value: str, key: str, tweak: str) -> str:
    half = len(value) // 2
    a, b = value[:half], value[half:]
    for r in range(ROUNDS):
        mac = _mac(key, tweak, r, b) << 256 | _mac(key, tweak, r, b, "x")
        a, b = b, f"{(int(a or '0', 16) + mac) % 16 ** len(a):0{len(a)}x}" if a else ""
    return a + b if ROUNDS % 2 == 0 else b + a


def _given(word: str, kind: str, key: str, draw: int) -> str:
    """A given name of the same gender, if it is known, and script; those that are in no list are dealt to one by hash."""
    script = script_of(word)
    if any(word in GIVEN[g, script] for g in kind[5:] or "fm"):
        return _name(word, kind[5:] or "fm", key, draw)
    names = [n for g in kind[5:] or "fm" for n in GIVEN[g, script]]
    return names[_mac(key, "given", kind, draw, word) % len(names)]


def _name(word: str, genders: str, key: str, draw: int) -> str:
    """Another given name of a list that has the word, else another surname. Surnames and single names take part in the lists
    of both genders, so that they do not depend on the title before them."""
    for gender in genders:
        names = GIVEN[gender, script_of(word)]
        if word in names:
            order = sorted(names, key=lambda n: _mac(key, "given", gender, draw, n))
            return order[(order.index(word) + 1) % len(order)]
    return permute(word, key, f"surname:{draw}" if draw else "surname")


def _identity(kind: str, value: str) -> str:
    return f"{'name' if kind.startswith('name_') else kind}\x1f{canonical(kind, value)}"


def _part(kind: str, value: str) -> str:
    """The identity of a name's surname; of anything else its own."""
    return _identity(kind, value.rpartition(" ")[2] if kind.startswith("name_") else value)


def secret_of(df: DataFrame, secret: str | None) -> str:
    """The key given, else the session's; where there is none the published one, with a warning."""
    found = secret or df.sparkSession.conf.get(SETTING, None)
    if not found:
        logging.getLogger(__name__).warning("surrogates are made with the published key; set %s", SETTING)
    return found or KEY


def find_entities(df: DataFrame, key: str = "doc_id", text: str = "text", secret: str | None = None) -> DataFrame:
    """(key, kind, value, entity, part, surrogate) for each entity found, values as written; part: the entity that a
    name's surname is, else the entity."""
    secret = secret_of(df, secret)
    fields = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "entity", "part", "surrogate")]))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        draw = functools.lru_cache(1 << 16)(surrogate)
        for s in batches:
            yield pd.Series([[] if t is None else [(k, t[a:b], _identity(k, t[a:b]), _part(k, t[a:b]), _identity(k, draw(k, t[a:b], secret))) for a, b, k in entities(t)] for t in s], dtype=object)

    found = text_batches(df).select(F.col(key).alias("doc"), F.pandas_udf(run, fields)(F.col(text)).alias("e"))
    return found.select(F.col("doc").alias(key), F.inline("e"))


def redraws(found: DataFrame, secret: str | None = None) -> DataFrame:
    """(entity, draw, kind) of the entities whose surrogate clashes (another entity has it, or it is a real one here) and of
    the persons met with titles of both genders, who have one kind, and so one surrogate, in all texts.

    Clashes are settled in rounds over the distinct entities, each an aggregation, until none is left; of those
    that share a surrogate the one drawn least often, then the smallest, keeps it. A surname drawn again changes with
    every given name. Given names are left out: their lists are permuted as a whole.
    """
    secret = secret_of(found, secret)
    given = [n for names in GIVEN.values() for n in names]
    def draws(kind: pd.Series, value: pd.Series, draw: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([_identity(k, surrogate(k, v, secret, int(d), int(p))) for k, v, d, p in zip(kind, value, draw, part, strict=True)], dtype=object)

    again = F.pandas_udf(draws, "string")
    # a person is what most of the mentions say, of either gender where there are as many of both
    women, men = (F.count_if(F.col("kind") == f"name_{g}") for g in "fm")
    e = found.groupBy("entity").agg(F.min(F.struct("kind", "value", "part", "surrogate")).alias("x"), (F.max("kind") != F.min("kind")).alias("mixed"), women.alias("women"), men.alias("men"))
    gender = F.when(F.col("women") > F.col("men"), "name_f").when(F.col("men") > F.col("women"), "name_m").otherwise("name_")
    e = e.select("entity", F.when(F.col("mixed"), gender).otherwise(F.col("x.kind")).alias("kind"), "x.value", "x.part", "x.surrogate", "mixed", F.lit(0).alias("draw"), F.lit(0).alias("part_draw"))
    seen = e.where("mixed").withColumn("surrogate", again("kind", "value", "draw", "part_draw"))
    e = stash(e.where("not mixed").unionByName(seen))
    while True:
        rank = F.row_number().over(Window.partitionBy("surrogate").orderBy("draw", "entity"))
        real = e.select(F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        bad = e.withColumn("i", rank).join(real, "surrogate", "left").withColumn("bad", (F.col("i") > 1) | F.coalesce(F.col("real"), F.lit(False)) & ~F.col("value").isin(given))
        bad = stash(bad.withColumn("draw", F.col("draw") + F.col("bad").cast("int")).drop("i", "real"))
        if bad.where("bad").isEmpty():
            return bad.where("draw > 0 or mixed").select("entity", "draw", "kind")
        surnames = bad.select(F.col("entity").alias("part"), F.col("draw").alias("now"))
        next_ = bad.join(surnames, "part", "left").withColumn("now", F.when(F.col("part") == F.col("entity"), F.lit(0)).otherwise(F.coalesce("now", F.lit(0))))
        changed = F.col("bad") | (F.col("now") != F.col("part_draw"))
        next_ = next_.withColumn("changed", changed).withColumn("part_draw", F.col("now"))
        stay = next_.where("not changed").select("entity", "kind", "value", "part", "surrogate", "mixed", "draw", "part_draw")
        move = next_.where("changed").withColumn("surrogate", again("kind", "value", "draw", "part_draw")).select(*stay.columns)
        e = stash(stay.unionByName(move))


def replace(df: DataFrame, key: str = "doc_id", text: str = "text", secret: str | None = None) -> DataFrame:
    """df with private data in `text` replaced, plus n_entities and `kinds` (distinct, sorted).

    secret: the key of the surrogates, see secret_of(). A null text stays null with no entities; texts without private
    data are unchanged. What redraws() says of the entities of a document, which is rare, reaches it by a join on a hash of
    key, of the text where the key is null; rows that share it share more than they need. All other columns stay; those
    named like results are replaced. An empty table gives an empty one.
    """
    secret = secret_of(df, secret)
    df = df.drop("n_entities", "kinds")
    out, own = df, prefix(df)
    link, draws, made = own + "link", own + "draws", own + "made"
    out = out.withColumn(link, F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)))
    found = stash(find_entities(out, link, text, secret))
    odd = stash(redraws(found, secret))
    if odd.isEmpty():
        out = out.withColumn(draws, F.lit(None).cast("map<string,struct<draw:int,kind:string>>"))
    else:
        of = found.select(F.col(link), F.explode(F.array_distinct(F.array("entity", "part"))).alias("entity")).distinct().join(odd, "entity")
        of = of.groupBy(link).agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("draw", "kind")))).alias(draws))
        out = out.join(of, link, "left")
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        make = functools.lru_cache(1 << 16)(surrogate)
        for texts, redrawn in batches:
            rows = []
            for t, d in zip(texts, redrawn, strict=True):
                hits = entities(t) if t is not None else []
                if not hits:
                    rows.append((t, [], 0))
                    continue
                d, at, parts = dict(d) if d is not None and len(d) else {}, 0, []
                first = {"draw": 0, "kind": None}
                for a, b, k in hits:
                    v = t[a:b]
                    what, part = d.get(_identity(k, v), first), d.get(_part(k, v), first)
                    parts += [t[at:a], make(what["kind"] or k, v, secret, int(what["draw"]), int(part["draw"]) if " " in v else 0)]
                    at = b
                rows.append(("".join(parts) + t[at:], sorted({k for _, _, k in hits}), len(hits)))
            yield pd.DataFrame(rows, columns=["text", "kinds", "n"])

    new = F.pandas_udf(run, schema)(F.col(text), F.col(draws))
    out = out.withColumn(made, new)
    return out.select(*[F.col(made)["text"].alias(c) if c == text else F.col(c) for c in df.columns], F.col(made)["n"].alias("n_entities"), F.col(made)["kinds"].alias("kinds"))


def op9_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    out = replace(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
