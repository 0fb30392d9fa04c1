"""Surrogates for personal data: keyed, of the same type and format, distinct, and the same for the same entity."""

from __future__ import annotations

import hmac
import math
import string
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pinweave.llm.rows import map_texts
from pinweave.runtime import Scratch

SAME_LENGTH = 6  # attempts at a surrogate of the value's own length; each further one adds a character
MAX_BROADCAST_CHARS = 32_000_000  # characters of edits that are sent to all executors; beyond it they are joined by a shuffle
FEISTEL_ROUNDS = 8

# Given names by gender, and the titles that tell a gender and announce a name.
FEMALE = ("Anna", "Maria", "Julia", "Laura", "Sarah", "Elena", "Sofia", "Claire", "Emma", "Lucia", "Alice", "Marta", "Ingrid", "Nora", "Helena", "Camille", "Greta", "Irene", "Paula", "Diana")
MALE = ("Peter", "Paul", "Thomas", "Martin", "David", "Lucas", "Daniel", "Jean", "Carlos", "Felix", "Hugo", "Oscar", "Simon", "Victor", "Bruno", "Andreas", "Louis", "Miguel", "Stefan", "Robert")
FEMALE_CYRILLIC = ("Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Татьяна", "Светлана", "Юлия", "Вера")
MALE_CYRILLIC = ("Иван", "Пётр", "Сергей", "Андрей", "Михаил", "Павел", "Дмитрий", "Виктор", "Юрий", "Олег")
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Sir": "m", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "Господин": "m", "Госпожа": "f",
}
GIVEN = {("f", "LATIN"): FEMALE, ("m", "LATIN"): MALE, ("f", "CYRILLIC"): FEMALE_CYRILLIC, ("m", "CYRILLIC"): MALE_CYRILLIC}
GENDERED = {name: gender for (gender, _), names in GIVEN.items() for name in names}
# The usual letters of a script within its block; letters elsewhere are replaced within their block of 256.
RANGES = ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF), (0x100, 0x17F), (0x391, 0x3A9), (0x3B1, 0x3C9), (0x400, 0x40F), (0x410, 0x42F), (0x430, 0x44F), (0x450, 0x45F))

_TITLE = rf"(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})"
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]|['’]\p{Lu})[\p{L}\p{M}]*(?:['’]\p{Lu}[\p{L}\p{M}]*)*(?![\p{L}\p{N}@_])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}._%+-]*[\p{L}\p{M}\p{N}_%+-])?@(?:[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}-]*[\p{L}\p{M}\p{N}])?\.)+\p{L}[\p{L}\p{M}]+"
NUMBER = r"(?<![\p{L}\p{N}_])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d(?:[ .-]?\d){2,18}(?![\p{L}\p{N}_])"
NAME = rf"\b{_TITLE}\b\.?[ ](?:\p{{Lu}}\.[ ]?){{0,2}}(?!{_TITLE}\b){_WORD}(?:[ -](?!{_TITLE}\b){_WORD}){{0,2}}"
PATTERNS = {"EMAIL": regex.compile(EMAIL), "NUMBER": regex.compile(NUMBER), "NAME": regex.compile(NAME)}
IPV4 = regex.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])")
IP_SPAN = regex.compile(rf"(?<![\p{{L}}\p{{N}}_.-]){IPV4.pattern}(?!\.?[\p{{L}}\p{{N}}_])")
LOCAL_PHONE = regex.compile(r"\d{3}[ .-]\d{3}[ .-]\d{4}")
SSN = regex.compile(r"\d{3}-\d{2}-\d{4}")
DIGIT_RUN = regex.compile(r"\d(?:[ .()+-]{0,2}\d){6}")


def luhn(digits: str) -> int:
    """Luhn sum of the digits mod 10; 0 for a valid card number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def number_type(s: str) -> str | None:
    """SSN, CARD (13 to 19 digits, bare or in groups) or PHONE (7 to 15 digits that begin with + or a bracket, or stand as 3, 3 and 4)."""
    digits = "".join(c for c in s if c.isdecimal())
    if SSN.fullmatch(s):
        return "SSN"
    if 13 <= len(digits) <= 19 and "." not in s and s[0] not in "+(" and (luhn(digits) == 0 or len(digits) == 16):
        return "CARD"
    if 7 <= len(digits) <= 15 and (s[0] in "+(" or LOCAL_PHONE.fullmatch(s)):
        return "PHONE"
    return None


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text as (start, end, type, gender), in order, none overlapping; the longer of two that start together."""
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), "EMAIL", "") for m in PATTERNS["EMAIL"].finditer(text)]
    ips = [(m.start(), m.end(), "IP", "") for m in IP_SPAN.finditer(text)]
    out += ips
    if DIGIT_RUN.search(text):
        rest = text
        for s, e, _, _ in ips:  # a number beside an address must not run into it
            rest = rest[:s] + "\0" * (e - s) + rest[e:]
        for m in PATTERNS["NUMBER"].finditer(rest):
            s, start = m[0], m.start()
            if kind := number_type(s):
                out.append((start, m.end(), kind, ""))
                continue
            at = 0  # a number set off by blanks from other digits
            for piece in s.split(" "):
                if kind := number_type(piece):
                    out.append((start + at, start + at + len(piece), kind, ""))
                at += len(piece) + 1
    for m in PATTERNS["NAME"].finditer(text):
        title, _, name = m[0].partition(" ")
        gender = TITLES[title.rstrip(".")] or GENDERED.get(regex.split("[ -]", name)[0], "")
        out.append((m.end() - len(name), m.end(), "NAME", gender))
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, end = [], 0
    for e in out:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


def canonical(kind: str, value: str) -> str:
    """What two mentions of one entity share: case of addresses and marks within numbers do not count."""
    if kind == "EMAIL":
        return value.lower()
    if kind in ("CARD", "PHONE", "SSN"):
        return "".join(str(unicodedata.digit(c)) for c in value if c.isdecimal())
    return value


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


@lru_cache(maxsize=100_000)
def alphabet(c: str) -> str:
    """What a letter or digit is replaced from: those of its script and category in its range or block; none for other characters."""
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return ""
    low, high = next((r for r in RANGES if r[0] <= ord(c) <= r[1]), (ord(c) & ~255, ord(c) | 255))
    own, script = map(chr, range(low, high + 1)), _script(c)
    out = "".join(x for x in own if unicodedata.category(x) == kind and (kind == "Nd" and unicodedata.decimal(x) >= 0 or _script(x) == script))
    if kind == "Nd":  # the ten of one set
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    return out if len(out) > 1 else string.ascii_lowercase


def _prf(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), "sha256"), "big")


def permute(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of range(size): a balanced Feistel network walked until it falls inside."""
    if size < 2:
        return x
    half = max(1, math.ceil((size - 1).bit_length() / 2))
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(FEISTEL_ROUNDS):
            left, right = right, left ^ (_prf(key, tweak, size, r, right) & mask)
        x = left << half | right
        if x < size:
            return x


def _respell(key: bytes, tweak: str, value: str, choice: int = 0, choices: int = 1) -> tuple[str, int]:
    """Replace letters and digits in place by a permutation of all strings of the same shape, together with one of ``choices``."""
    spots = [(i, a) for i, c in enumerate(value) if (a := alphabet(c))]
    x, size = 0, choices
    for i, a in spots:
        x = x * len(a) + max(a.find(value[i]), 0)
        size *= len(a)
    x = permute(key, f"{tweak}|{len(spots)}", x * choices + choice, size)
    x, choice = divmod(x, choices)
    out = list(value)
    for i, a in reversed(spots):
        x, k = divmod(x, len(a))
        out[i] = a[k]
    return "".join(out), choice


def _name(key: bytes, tweak: str, value: str, gender: str) -> str:
    """A given name of the same gender and script where the first word is one, all else respelt in its own script.

    The given name and the rest are permuted as one, so that bearers of one surname stay apart.
    """
    first = regex.match("[^ -]+", value)[0]
    names = GIVEN.get((gender, _script(first[0])), ())
    if names and "." not in first and (first in names or len(first) < len(value)):
        own = names.index(first) if first in names else _prf(key, tweak, "given", first) % len(names)
        rest, own = _respell(key, tweak, value[len(first) :], own, len(names))
        return names[own] + rest
    return _respell(key, tweak, value)[0]


def surrogate(key: bytes, kind: str, value: str, gender: str = "", attempt: int = 0) -> str:
    """The replacement of a canonical value: same type, shape, script and, for names, gender.

    From attempt SAME_LENGTH on it is longer by one character for each attempt, so the
    values to choose from never run out (an IP address keeps its four numbers).
    """
    tweak, more = f"{kind}|{attempt}", max(0, attempt - SAME_LENGTH + 1)
    draw = lambda a: "".join(a[_prf(key, tweak, "more", value, i) % len(a)] for i in range(more))
    if kind == "EMAIL":
        dot, at = value.rindex("."), value.index("@")
        new = _respell(key, tweak, value[:dot])[0]
        return new[:at] + draw(string.ascii_lowercase) + new[at:] + value[dot:]
    if kind == "IP":
        x = permute(key, tweak, int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "NAME":
        return _name(key, tweak, value, gender) + draw(alphabet(value[-1]) or string.ascii_lowercase)
    n = len(value) - (kind == "CARD")
    x = str(permute(key, f"{tweak}|{n}", int(value[:n]), 10**n)).zfill(n) + draw(string.digits)
    if kind != "CARD":
        return x
    off = luhn(value)  # the check digit keeps its distance from a valid one
    return x + next(str(d) for d in range(10) if luhn(x + str(d)) == off)


def in_form(kind: str, written: str, new: str) -> str:
    """A canonical surrogate written as the mention was: marks within numbers, its own script's digits, capitals in addresses."""
    if kind == "EMAIL":
        if len(new) != len(written):
            return new
        return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(written, new, strict=True))
    if kind in ("CARD", "PHONE", "SSN"):
        digits, out, zero = iter(new), [], 48
        for c in written:
            if c.isdecimal():
                zero = ord(c) - unicodedata.decimal(c)
                c = chr(zero + int(next(digits)))
            out.append(c)
        return "".join([*out, *[chr(zero + int(d)) for d in digits]])
    return new


def replaced(text: str, edits: list[tuple[str, int, int, str]]) -> str:
    """The text with each (kind, start, end, surrogate) written in its mention's form."""
    out, at = [], 0
    for kind, s, e, new in sorted(edits, key=lambda x: x[1]):
        out += [text[at:s], in_form(kind, text[s:e], new)]
        at = e
    return "".join([*out, text[at:]])


def _mentions(texts: DataFrame) -> DataFrame:
    """Mentions of each text that has any: k1, k2, found (kind, start, end, canonical value, gender)."""

    def make():
        def work(texts):
            return [[[{"kind": k, "s": s, "e": e, "value": canonical(k, t[s:e]), "gender": g} for s, e, k, g in find(t)] for t in texts]]

        return work

    kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("value", pa.string()), ("gender", pa.string())]))
    found = map_texts(texts, make, [("found", kind, "array<struct<kind:string,s:int,e:int,value:string,gender:string>>")])
    return found.where(F.size("found") > 0)


def _assign(rows: DataFrame, key: bytes) -> DataFrame:
    """Add ``new``, the surrogate of kind, value, gender and attempt."""

    def run(batches):
        for batch in batches:
            c = batch.to_pydict()
            new = [surrogate(key, *x) for x in zip(c["kind"], c["value"], c["gender"], c["attempt"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, type=pa.string())], names=[*batch.schema.names, "new"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("new", StringType())]))


def settle(entities: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """Entities with their surrogates, no two alike within a kind and none equal to an entity of the corpus.

    Permutations keep values of one shape apart; what still meets (names of few
    spellings, a surrogate that someone bears) is tried again with the next attempt,
    all but the first by value, until nothing meets. Later attempts are longer, so they
    end.
    """
    cur = scratch.keep(_assign(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = entities.select("kind", F.col("value").alias("new"), F.lit(True).alias("borne"))
    attempt = 0
    while True:
        attempt += 1
        least = cur.groupBy("kind", "new").agg(F.min("value").alias("owner"), F.count("*").alias("n"))
        clash = least.join(real, ["kind", "new"], "left").where("n > 1 OR borne").select("kind", "new", F.when(F.col("borne").isNull(), F.col("owner")).alias("owner"))
        clash = scratch.keep(clash, "clash")
        if clash.isEmpty():
            return cur
        marked = cur.join(clash.withColumn("hit", F.lit(True)), ["kind", "new"], "left")
        again = F.coalesce(F.col("hit"), F.lit(False)) & (F.col("owner").isNull() | (F.col("owner") != F.col("value")))
        stay = marked.where(~again).select(*cur.columns)
        move = marked.where(again).select("kind", "value", "gender").withColumn("attempt", F.lit(attempt))
        nxt = scratch.keep(stay.unionByName(_assign(move, key)), "surrogates")
        scratch.drop(cur, clash)
        cur = nxt


def pseudonymise(docs: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """Replace e-mail and IPv4 addresses, card, phone and social-security numbers and titled names in every whole text.

    A mention gets the surrogate of its entity, so mentions of one entity keep
    agreeing across the corpus and different entities stay different. The surrogate
    is a keyed permutation of all values of the same shape, letter by letter within
    its script and case, written in the mention's own format and digits; a given name
    becomes one of the same gender. Surrogates are checked over the whole corpus
    against each other and against real entities; those that collide are settled by
    further attempts. Texts are searched once: their mentions, by two hashes of the
    text, meet their surrogates and come back to the texts as edits, by broadcast up
    to ``MAX_BROADCAST_CHARS`` and else by a shuffled join. Texts without any never
    leave the JVM again.

    Returns doc_id, text, n_entities and entities (``kind:start:end`` in code points of
    the original, comma joined). Null texts stay null with 0 entities; texts without
    entities come back unchanged; null doc_ids and repeated rows are treated like any
    other; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    found = scratch.keep(_mentions(keyed.where("text <> ''").select("k1", "k2", "text")).dropDuplicates(["k1", "k2"]), "mentions")
    each = found.select("k1", "k2", F.explode("found").alias("x")).select("k1", "k2", "x.*")
    settled = settle(scratch.keep(each.groupBy("kind", "value").agg(F.max("gender").alias("gender")), "entities"), key, scratch)
    edits = each.join(settled.select("kind", "value", "new"), ["kind", "value"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "s", "e", "new")).alias("edits"))
    edits = scratch.keep(edits, "edits")
    chars = edits.agg(F.sum(F.aggregate("edits", F.lit(0).cast("long"), lambda n, x: n + 16 + F.length(x["new"])))).first()[0] or 0
    both = keyed.join(F.broadcast(edits) if chars <= MAX_BROADCAST_CHARS else edits, ["k1", "k2"], "left")

    def make():
        def work(both):
            out = []
            for b in both:
                e = sorted((x["kind"], x["s"], x["e"], x["new"]) for x in b["edits"])
                out.append((replaced(b["text"], e), len(e), ",".join(f"{k}:{s}:{t}" for k, s, t, _ in sorted(e, key=lambda x: x[1]))))
            return list(map(list, zip(*out, strict=True))) if out else [[], [], []]

        return work

    fields = [("new_text", pa.string(), "string"), ("n_entities", pa.int64(), "long"), ("entities", pa.string(), "string")]
    done = map_texts(both.where("edits IS NOT NULL").select("doc_id", F.struct("text", "edits").alias("both")), make, fields, column="both")
    rest = both.where("edits IS NULL").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entities"))
    return rest.union(done.select("doc_id", F.col("new_text").alias("text"), "n_entities", "entities"))
