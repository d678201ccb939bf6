"""PII: detected entities get keyed surrogates of the same kind, format, script and gender.

A surrogate is made from an HMAC of the entity's canonical form, so one entity has one surrogate in the whole corpus,
whatever its spelling in a place. The distinct entities are then held against each other: if two share a surrogate, or a
surrogate is itself an entity of the corpus, all but the first get the next one, until none collide. After some
attempts surrogates get longer, so there are always enough of them: then distinctness goes before length, and that
is bounded by MOST attempts, of which the last is long enough to be distinct by its hash. The few that moved on are sent along with the texts;
all others are made again where they are needed. Domains of addresses are entities of their own, so one domain stays one domain. Given names
are a fixed list: a keyed permutation of each gender's names, without fixed points, keeps them distinct, and needs no check.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, saved, slices, tidy

KEY = b"surrogates"  # a parameter; keep the real one secret
GROW, MOST = 6, 48  # attempts before a surrogate gets a letter longer, for each letter; attempts at all
SEND = 50_000  # moved entities that are sent to all executors; beyond it they are joined by text

# Given names by gender.
GIVEN = {
    "f": "Alice Anna Barbara Carol Claire Diana Elena Emma Eva Grace Hannah Helen Ingrid Irene Jane Julia Karen Laura Linda Lucy Maria Marie Martha Mary Nadia Nina Olivia Patricia Petra Rachel Rosa Ruth Sandra Sara Sarah Sofia Sophie Susan Teresa Ursula Vera".split(),
    "m": "Adam Alan Albert Andrew Anton Arthur Ben Bruno Carl Carlos Charles Daniel David Edward Eric Felix Frank George Hans Henry Hugo Ivan Jack James Jan John Jose Karl Louis Luis Mark Martin Max Michael Oscar Otto Paul Pedro Peter Robert Thomas".split(),
}
GENDER = {n.lower(): g for g, names in GIVEN.items() for n in names}
# Titles before a name.
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Mme Sra".split())
# What announces a person's full name.
CUES = ("my name is ", "full name: ", "signed by ", "je m'appelle ", "ich heiße ", "me llamo ", "mi nombre es ", "mein name ist ")
SCRIPTS = ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшщэюя")
VOWELS = ("aeiou", "αεηιουω", "аеиоуэюя")

_NAME = r"[^\W\d_]{2,}(?:['’-](?![Ss]\b)[^\W\d_]+)*"
# What an entity looks like; the first kind that matches at a place wins.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "ip": r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d{4}(?P<sep>[\x20-]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)|\d{2,4})[\x20.-]\d{3,4}[\x20.-]?\d{3,4}(?![\w-])|(?<!\w)\+\d{8,15}(?!\w)",
}
_NUMBERS = re.compile(r"(?=[\dA-Z+(])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items() if k != "email") + ")")
_MAY_HOLD_NUMBERS = re.compile(r"\d[\d\x20().-]{5}|[A-Z]{2}\d\d")  # every kind of number has one of these
_EMAIL, _LOCAL = re.compile(PATTERNS["email"]), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_CAPITAL = re.compile(r"[A-Z][^\W\d_]*")  # what a title or a given name begins with; others need a cue
_AFTER_TITLE, _AFTER_GIVEN, _WORD = re.compile(rf"\.?\x20{{1,2}}({_NAME})(?:\x20({_NAME}))?(?!\w)"), re.compile(rf"\x20({_NAME})(?!\w)"), re.compile(rf"{_NAME}(?!\w)")


def people(text: str) -> Iterator[tuple[int, int, str]]:
    """The names of persons: after a title (in any script), a given name with what follows it, and full names after a cue."""
    end = 0
    for m in _CAPITAL.finditer(text):
        at = m.start()
        if at < end or (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            continue
        names = []
        if m[0] in TITLES:
            if found := _AFTER_TITLE.match(text, m.end()):
                names = [found.span(i) for i in (1, 2) if found[i] and not found[i][0].islower()]
                names = names if names and names[0] == found.span(1) else []
        elif m[0].lower() in GENDER:
            if (found := _AFTER_GIVEN.match(text, m.end())) and not found[1][0].islower():
                names = [m.span(), found.span(1)]
        elif text[max(0, at - 16) : at].lower().endswith(CUES) and (first := _WORD.match(text, at)):
            if (found := _AFTER_GIVEN.match(text, first.end())) and not found[1][0].islower():
                names = [first.span(), found.span(1)]
        for i, (s, e) in enumerate(names):
            yield s, e, "given" if i == 0 and text[s:e].lower() in GENDER else "surname"
            end = e


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, without overlaps, in order."""
    out, at = [], text.find("@")
    while at >= 0:  # from each @ back to where the local part begins, so that long words cost nothing
        start = at
        while start and at - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)) and m.end() > at:
            out.append((start, m.end(), "email"))
            at = m.end() - 1
        at = text.find("@", at + 1)
    if _MAY_HOLD_NUMBERS.search(text):
        out += [(m.start(), m.end(), m.lastgroup if m.lastgroup != "sep" else "card") for m in _NUMBERS.finditer(text)]
    out += people(text)
    out.sort(key=lambda x: (x[0], -x[1]))
    kept, end = [], 0
    for s in out:
        if s[0] >= end:
            kept.append(s)
            end = s[1]
    return kept


def canonical(kind: str, value: str) -> str:
    """What all spellings of one entity have in common."""
    if kind in ("card", "phone", "ssn"):
        return "".join(str(unicodedata.decimal(c)) for c in value if c.isdecimal())
    return value.replace(" ", "").lower()


def entities_of(text: str) -> set[tuple[str, str]]:
    """(kind, canon) of the entities of a text; an address's domain is one of them."""
    out = {(k, canonical(k, text[s:e])) for s, e, k in find(text)}
    return out | {("domain", c.rpartition("@")[2]) for k, c in out if k == "email"}


class Stream:
    """Keyed pseudo-random numbers."""

    def __init__(self, key: bytes, *of: object) -> None:
        self.key, self.of, self.n, self.left = key, "\0".join(map(str, of)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.digest(self.key, self.of + b"\0%d" % self.n, "sha256")
            self.n += 1
        out, self.left = int.from_bytes(self.left[:4], "big") % n, self.left[4:]
        return out


def _luhn(digits: str) -> int:
    return sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]), 1)) % 10


def _iban_rest(iban: str) -> int:
    """An account number modulo 97; 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


@lru_cache(maxsize=65536)
def pool_of(c: str) -> str:
    """What a small letter may become: letters of its sort (vowel or not) in the known scripts, else those of its category and Unicode neighbourhood; a digit any digit."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return c
    for letters, vowels in zip(SCRIPTS, VOWELS, strict=True):
        if c in letters:
            return vowels if c in vowels else "".join(x for x in letters if x not in vowels)
    base, sort = ord(c) & ~127, unicodedata.category(c)
    return "".join(x for x in map(chr, range(base, base + 128)) if unicodedata.category(x) == sort and len(x.upper()) == 1 and x.upper().lower() == x.lower()) or c


def _letters(text: str, rnd: Stream) -> str:
    """Each letter for another of its script and sort, each digit for a digit; the rest as it is."""
    return "".join(p[rnd.below(len(p))] for p in map(pool_of, text))


def _more(text: str, attempt: int, rnd: Stream) -> str:
    """What later attempts add: letters of the text's script, at the last attempt enough to be distinct by themselves."""
    like = next((c for c in text if c.isalpha()), "a")
    pool = pool_of(like) if len(pool_of(like)) > 4 else SCRIPTS[0]
    return "".join(pool[rnd.below(len(pool))] for _ in range(32 if attempt >= MOST else attempt // GROW))


@lru_cache(maxsize=8)
def given_names(key: bytes) -> dict[str, str]:
    """Each given name's surrogate: one keyed cycle through all names of its gender, so all differ and none is itself."""
    out = {}
    for gender, names in GIVEN.items():
        rnd, cycle = Stream(key, "given", gender), [n.lower() for n in names]
        for i in range(len(cycle) - 1, 0, -1):
            j = rnd.below(i + 1)
            cycle[i], cycle[j] = cycle[j], cycle[i]
        out |= dict(zip(cycle, cycle[1:] + cycle[:1], strict=True))
    return out


def surrogate(kind: str, canon: str, key: bytes = KEY, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate at an attempt. An address's is told with its own domain, which is replaced apart."""
    if kind == "given":
        return given_names(key)[canon]
    rnd = Stream(key, kind, canon, attempt)
    if kind in ("email", "domain"):
        name, sep, rest = canon.rpartition("@" if kind == "email" else ".")
        return f"{_letters(name, rnd)}{_more(name, attempt, rnd)}{sep}{rest}"
    if kind == "ip":
        return ".".join(str(1 + rnd.below(254)) for _ in range(4 + (attempt >= GROW) * (1 + attempt // GROW)))
    if kind == "iban":
        out = canon[:4] + _letters(canon[4:], rnd) + "".join(str(rnd.below(10)) for _ in range(32 if attempt >= MOST else attempt // GROW))
        check = 98 - _iban_rest(out[:2] + "00" + out[4:]) if _iban_rest(canon) == 1 else rnd.below(100)
        return f"{out[:2]}{check:02d}{out[4:]}"
    if kind in ("card", "phone", "ssn"):
        fixed = max(0, len(canon) - 10) if kind == "phone" else 0  # a country's code stays
        out = canon[:fixed] + str(1 + rnd.below(9)) + "".join(str(rnd.below(10)) for _ in range(len(canon) - fixed - 1 + (32 if attempt >= MOST else attempt // GROW)))
        return out[:-1] + str(-_luhn(out[:-1] + "0") % 10) if kind == "card" and _luhn(canon) == 0 else out
    return _letters(canon, rnd) + _more(canon, attempt, rnd)


def shaped(kind: str, value: str, out: str) -> str:
    """The surrogate in the spelling of the place: its separators, digits and case; what it is longer comes last."""
    if kind == "ip":
        return out
    if kind == "given":
        return out.upper() if value.isupper() else out.capitalize()
    chars, parts = iter(out), []
    for c in value:
        if (kind in ("card", "phone", "ssn") and not c.isdecimal()) or c == " ":
            parts.append(c)
            continue
        x = next(chars)
        if c.isdecimal() and not c.isascii() and x.isascii():
            x = chr(ord(c) - unicodedata.decimal(c) + int(x))
        parts.append(x.upper() if c.isupper() else x)
    return "".join([*parts, *chars])


def replaced(kind: str, value: str, moved: dict, key: bytes) -> str:
    """What stands for an entity as it is spelt in a place."""
    canon = canonical(kind, value)
    out = moved.get((kind, canon)) or surrogate(kind, canon, key)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return f"{shaped(kind, local, out.rpartition('@')[0])}@{replaced('domain', domain, moved, key)}"
    if kind == "domain":
        host, dot, top = value.rpartition(".")
        return f"{shaped(kind, host, out.rpartition('.')[0])}{dot}{top}"
    return shaped(kind, value, out)


def replace(text: str, moved: dict, key: bytes) -> tuple[str, str, int]:
    """(text with surrogates, kind:start:end of what was found, how many)."""
    spans, parts, at = find(text), [], 0
    for s, e, kind in spans:
        parts += [text[at:s], replaced(kind, text[s:e], moved, key)]
        at = e
    return "".join([*parts, text[at:]]), ",".join(f"{k}:{s}:{e}" for s, e, k in spans), len(spans)


def entities(texts: DataFrame) -> DataFrame:
    """kind, canon of the distinct entities of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            found = sorted(set().union(*(entities_of(t) for t in b.column(0).to_pylist() if t)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["kind", "canon"])
        tidy()

    return texts.mapInArrow(run, "kind string, canon string").distinct()


def collisions_resolved(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, attempt, out: one surrogate per entity, all different and none an entity; given names are permuted among themselves, so they differ but are names of the list.

    found: the distinct entities, a table. Of entities that share a surrogate the one with the fewest attempts keeps it, then the first in order.
    """

    def made(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds, canons, attempts = (c.to_pylist() for c in b.columns)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(*x) for x in zip(kinds, canons, [key] * len(kinds), attempts, strict=True)], pa.string())], ["kind", "canon", "attempt", "out"])

        return df.select("kind", "canon", "attempt").mapInArrow(run, "kind string, canon string, attempt int, out string")

    table = saved(made(found.withColumn("attempt", F.lit(0))), "surrogates")
    for _ in range(MOST):
        checked = table.filter("kind <> 'given'")
        first = checked.groupBy("kind", "out").agg(F.min(F.struct("attempt", "canon")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("kind", "out", "f.canon")
        shared = checked.join(first.select("kind", "out"), ["kind", "out"], "left_semi").join(first, ["kind", "out", "canon"], "left_anti")
        real = checked.join(found.select("kind", F.col("canon").alias("out")), ["kind", "out"], "left_semi")
        again = saved(shared.unionByName(real).select("kind", "canon").distinct(), "collided")
        if again.isEmpty():
            break
        moved = made(table.join(again, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1))
        before, table = table, saved(table.join(again, ["kind", "canon"], "left_anti").unionByName(moved), "surrogates")
        discard(before, again)
    return table


def pseudonymise(docs: DataFrame, key: bytes = KEY, send: int = SEND) -> DataFrame:
    """One row per input row: doc_id, n_found, spans (kind:start:end in the input, comma-joined) and text with surrogates.

    Texts without entities come out as they are; null texts as null. Null ids and repeated rows are rows like others. An empty
    table gives no rows; columns other than doc_id and text are ignored. The result depends on the key and the corpus alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = saved(entities(rows.select("text")), "entities")
    moved = collisions_resolved(found, key).filter("attempt > 0").select("kind", "canon", "out")
    few = moved.count() <= send
    sent = {(r.kind, r.canon): r.out for r in moved.collect()} if few else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            extra = b.column(2).to_pylist()
            out = [(None, "", 0) if t is None else replace(t, sent if few else {(m["kind"], m["canon"]): m["out"] for m in x or ()}, key) for t, x in zip(b.column(1).to_pylist(), extra, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[2] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[0] for x in out], pa.string())], ["doc_id", "n_found", "spans", "text"])

    if few:
        rows = rows.withColumn("moved", F.lit(None).cast("array<struct<kind: string, canon: string, out: string>>"))
    else:  # each text that holds a moved entity gets its own few
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                x = sorted({(h, *e) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for e in entities_of(t or "")})
                yield pa.RecordBatch.from_arrays([pa.array([y[i] for y in x], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["th", "kind", "canon"])

        rows = rows.withColumn("th", F.xxhash64("text"))
        held = rows.select("th", "text").mapInArrow(places, "th long, kind string, canon string").distinct().join(moved, ["kind", "canon"])
        per = held.groupBy("th").agg(F.collect_list(F.struct("kind", "canon", "out")).alias("moved"))
        rows = rows.join(per, "th", "left").select("doc_id", "text", "moved")
    return rows.mapInArrow(run, "doc_id long, n_found long, spans string, text string")
