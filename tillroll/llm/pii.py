"""Personal data: each entity gets a keyed surrogate of its own type, gender, script and format.

* Detection finds emails, phone, card and social security numbers, IBANs with a
  right check number, IP addresses of both versions, access keys, passwords and
  tokens, and names behind an honorific, in whole texts.  A name found so is
  found again wherever its words stand alone in the same text, and is one entity
  there whatever the honorific (that of its first place tells the gender).
  Names that no honorific introduces are not found.
* An entity is its *canonical* form (digits of a number, lower case of an
  address, a word of a name), so the same number written in two ways, or the
  same person with and without a first name, stays one entity: coreference.
* The surrogate is drawn from a keyed hash of type, canonical form and attempt,
  and then laid into the format of each place: separators, letter case and
  leading zeros stay, digits become digits, hexadecimal stays hexadecimal, a
  card number or IBAN that passed its check still does, names keep script and
  gender (endings of either behind an honorific without one).
* Collision checks over the whole corpus: no two entities of a type may get the
  same surrogate, and none may get what is another entity's original.  All but
  the first try the next attempt until none collides.  Formats can be full (all
  two-digit locals of a host): after ``MOST_ATTEMPTS`` each attempt is a character
  longer than the one before, so there is always a free surrogate.

Only entities that needed another attempt are brought to their documents by a
join; all others follow from the key alone, so texts are not shuffled for them.

Defined cases: null texts stay null, empty ones empty; repeated rows change
alike; documents are known by (doc_id, hash of text) within the job, so ids may
repeat or be null; an empty table stays empty; further columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.text import table
from tillroll.storage import written

KEY = "surrogates-1"
#: So many attempts keep the length of the original; each later one is a character longer.
MOST_ATTEMPTS = 64

#: Honorifics and the gender they tell.
HONORIFICS = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "господин": "m", "г-н": "m", "κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Doña": "f", "госпожа": "f", "г-жа": "f", "κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n", "доктор": "n",
}
#: Syllables and endings of made-up names by script.
SYLLABLES = {
    "latin": (["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pe", "ra", "si", "to", "va", "we", "zo", "lu"], {"m": ["n", "r", "s", "k"], "f": ["na", "ra", "la", "sa"]}),
    "cyrillic": (["ба", "де", "фи", "го", "ка", "ле", "ми", "но", "пе", "ра", "си", "то", "ва", "ре", "зо", "лу"], {"m": ["н", "р", "с", "к"], "f": ["на", "ра", "ла", "са"]}),
    "greek": (["βα", "δε", "φι", "γο", "κα", "λε", "μι", "νο", "πε", "ρα", "σι", "το", "θα", "ρε", "ζο", "λυ"], {"m": ["νος", "ρης", "σας", "κος"], "f": ["να", "ρα", "λα", "σα"]}),
}

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[+(]?\d(?:[ ().-]{0,2}\d)+")
_CARD = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\) ?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\d{3}([.-])\d{3}\1\d{4}|\d{3} \d{3} \d{4}")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IP6 = re.compile(r"(?<![\w:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")
_ACCESS_STARTS = re.compile(r"AKIA|gh[opsu]_|sk-")
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
_SECRET = re.compile(r"(?:password|passwd|secret|token|api_key|apikey)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_/+-]{8,})", re.I)
_SECRET_WORDS = ("assw", "ecret", "oken", "ASSW", "ECRET", "OKEN", "api", "API")
_NAME = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, HONORIFICS), key=len, reverse=True)) + r")\.?[  ]((?:[^\W\d_a-zа-яα-ω][^\W\d_]+)(?:[ -][^\W\d_a-zа-яα-ω][^\W\d_]+){0,2})")
_DIGIT = re.compile(r"\d")
_DRAWN = re.compile(r"[A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_rest(canonical: str) -> int:
    """The remainder that a right IBAN leaves 1 of."""
    return int("".join(str(int(c, 36)) for c in canonical[4:] + canonical[:4])) % 97


def _is_ip6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return text.count(":") > 2 and _DIGIT.search(text) is not None


def script(word: str) -> str:
    c = word[:1].lower()
    return "cyrillic" if "а" <= c <= "я" or c == "ё" else "greek" if "α" <= c <= "ω" or c in "άέήίόύώ" else "latin"


def _number(text: str) -> tuple[str, str] | None:
    """Type and canonical form of a run of digits and separators, if it is an entity."""
    digits = "".join(filter(str.isdecimal, text))
    if not digits.isascii():
        return None
    if _IP.fullmatch(text):
        return ("ip", text) if all(int(x) <= 255 for x in text.split(".")) else None
    if _SSN.fullmatch(text):
        return "ssn", digits
    if _CARD.fullmatch(text):
        return ("card+" if luhn(digits) else "card", digits)
    if _PHONE.fullmatch(text) and 7 <= len(digits) <= 15:
        return "phone", digits
    return None


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text as (start, end, type, canonical form), in order, none overlapping."""
    found = []
    if any(w in text for w in _SECRET_WORDS):
        # The line to fill in on a form is no secret.
        found += [(*m.span(1), "secret", m[1]) for m in _SECRET.finditer(text) if _DRAWN.search(m[1])]
    if _ACCESS_STARTS.search(text):
        found += [(*m.span(), "access", m[0]) for m in _ACCESS.finditer(text)]
    for m in _IBAN.finditer(text):
        if iban_rest(canonical := m[0].replace(" ", "")) == 1:
            found.append((*m.span(), "iban", canonical))
    if text.count(":") > 2:
        found += [(*m.span(), "ip6", m[0].lower()) for m in _IP6.finditer(text) if _is_ip6(m[0])]
    if "@" in text:
        found += [(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            for begin, end in _parts(m[0]):
                if known := _number(m[0][begin:end]):
                    found.append((m.start() + begin, m.start() + end, *known))
    named: dict[str, str] = {}
    for m in _NAME.finditer(text):
        gender, at = HONORIFICS[m[1]], m.start(2)
        words = list(re.finditer(r"[^ -]+", m[2]))
        for i, w in enumerate(words):
            kind = "surname" if i == len(words) - 1 else "given"
            known = named.setdefault(w[0].lower(), f"{kind}:{gender}:{script(w[0])}")
            found.append((at + w.start(), at + w.end(), known, w[0].lower()))
    if named:
        found += [(*m.span(), named[m[0].lower()], m[0].lower()) for m in _WORD.finditer(text) if m[0].lower() in named and m[0][0].isupper()]
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def _parts(run: str) -> list[tuple[int, int]]:
    """A run of digits and separators is one entity, or several set apart by spaces."""
    if _number(run):
        return [(0, len(run))]
    cuts = [0, *[i for i, c in enumerate(run) if c == " "], len(run)]
    parts, begin = [], 0
    while begin < len(run):
        ends = [c for c in cuts if c > begin]
        end = next((e for e in reversed(ends) if _number(run[begin:e])), ends[0])
        parts.append((begin, end))
        begin = end + (run[end : end + 1] == " ")
    return parts


def _numbers(key: str, *what):
    """A keyed stream of bytes."""
    n = 0
    while True:
        yield from hmac.digest(key.encode(), "\x00".join(map(str, (*what, n))).encode(), hashlib.sha256)
        n += 1


def surrogate(kind: str, canonical: str, attempt: int, key: str = KEY) -> str:
    """The canonical form of an entity's surrogate."""
    draw = _numbers(key, kind, canonical, attempt)
    pick = lambda letters: letters[(next(draw) << 16 | next(draw) << 8 | next(draw)) % len(letters)]
    longer = max(0, attempt - MOST_ATTEMPTS + 1)
    if kind == "ip":
        return ".".join(str(1 + (next(draw) << 8 | next(draw)) % 254) for _ in range(4 + longer))
    if kind == "ip6":
        shape = canonical if not longer else ":".join(["0000"] * 8)
        return "".join(c if c == ":" else pick("0123456789abcdef") for c in shape)
    if kind == "iban":
        body = _alike(_lengthened(canonical[4:], longer), draw)
        return f"{canonical[:2]}{98 - iban_rest(canonical[:2] + '00' + body):02}{body}"
    if kind in ("card", "card+", "phone", "ssn"):
        # The first digit (a country code, an issuer) stays.
        body = canonical[0] + "".join(pick("0123456789") for _ in range(len(canonical) - 1 + longer))
        if kind == "card+":
            body = next(body[:-1] + d for d in "0123456789" if luhn(body[:-1] + d))
        return body
    if ":" in kind:
        part, gender, alphabet = kind.split(":")
        syllables, endings = SYLLABLES[alphabet]
        # Later attempts are longer, so there is always a free name.
        return "".join(pick(syllables) for _ in range(2 + (part == "surname") + attempt // 2)) + pick(endings.get(gender) or endings["m"] + endings["f"])
    if kind == "email":
        local, _, domain = canonical.partition("@")
        host, _, top = domain.rpartition(".")
        alike = _numbers(key, "domain", host, 0)
        if not _DRAWN.search(local):
            # The one local of its format, so no further attempt would differ.
            longer = attempt
        return f"{_alike(_lengthened(local, longer), draw)}@{_alike(host, alike)}.{top}"
    text = _lengthened(canonical, longer)
    stays = _ACCESS_STARTS.match(text).end() if kind == "access" else 0
    return text[:stays] + _alike(text[stays:], draw)


def _lengthened(text: str, more: int) -> str:
    """The text with more characters of the class of its last letter or digit."""
    return text + next((c for c in reversed(text) if _DRAWN.match(c)), "a") * more


def _alike(text: str, draw) -> str:
    """Each character replaced within its class; text that is hexadecimal stays so."""
    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
    classes = ["0123456789", "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz", "ABCDEF" if hexadecimal else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    out = []
    for c in text:
        letters = next((x for x in classes if c in x or (c.isascii() and c.islower() and x[0] == "a") or (c.isascii() and c.isupper() and x[0] == "A")), None)
        out.append(c if letters is None else letters[(next(draw) << 8 | next(draw)) % len(letters)])
    return "".join(out)


def laid_into(place: str, kind: str, new: str) -> str:
    """A surrogate in the format of the place: its separators and its letter case."""
    if kind == "iban":
        letters = iter(new)
        return "".join([*(c if c == " " else next(letters) for c in place), *letters])
    if kind == "ip6":
        return new.upper() if place != place.lower() else new
    if kind in ("card", "card+", "phone", "ssn"):
        digits = iter(new)
        return "".join([*(next(digits) if c.isdecimal() else c for c in place), *digits])
    if ":" in kind:
        return new.upper() if place.isupper() and len(place) > 1 else new[:1].upper() + new[1:]
    if kind == "email":
        # What a later attempt has more stands before the @ and is lower case.
        at, more = place.index("@"), len(new) - len(place)
        place = place[:at] + " " * more + place[at:]
        return "".join(n.upper() if c.isupper() else n for c, n in zip(place, new))
    return new


def replace(text: str, attempts: dict[tuple[str, str], int], key: str = KEY) -> tuple[str, list[str]]:
    """The text with surrogates, and the types replaced, in order."""
    out, at, kinds = [], 0, []
    for begin, end, kind, canonical in find(text):
        new = surrogate(kind, canonical, attempts.get((kind, canonical), 0), key)
        out += [text[at:begin], laid_into(text[begin:end], kind, new)]
        at = end
        kinds.append(kind)
    return ("".join([*out, text[at:]]) if kinds else text), kinds


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> distinct (doc_id, text_hash, kind, canonical)."""

    def scan(batches):
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(2)):
                rows += [(i, *x) for x in dict.fromkeys((k, c) for _, _, k, c in find(t.as_py() or ""))]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "text_hash", "kind", "canonical"],
            )

    given = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return given.mapInArrow(scan, "doc_id long, text_hash long, kind string, canonical string")


def assign(found: DataFrame, key: str = KEY, draw=surrogate) -> DataFrame:
    """Distinct (kind, canonical) -> plus attempt and surrogate, with no two alike and none an original."""

    def drawn(batches):
        for batch in batches:
            kinds, forms, tries = (c.to_pylist() for c in batch.columns)
            new = [draw(k, c, n, key) for k, c, n in zip(kinds, forms, tries)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "canonical", "attempt", "surrogate"])

    now = found.select("kind", "canonical").distinct().withColumn("attempt", F.lit(0))
    originals = written(now.select(F.col("kind").alias("__k"), F.col("canonical").alias("__c")), "originals")
    now = originals.select(F.col("__k").alias("kind"), F.col("__c").alias("canonical"), F.lit(0).alias("attempt"))
    # An entity that settled early keeps its surrogate; the rest go by canonical form.
    first = Window.partitionBy("kind", "surrogate").orderBy("attempt", "canonical")
    while True:
        with_new = now.mapInArrow(drawn, "kind string, canonical string, attempt int, surrogate string")
        taken = (F.col("kind") == F.col("__k")) & (F.col("surrogate") == F.col("__c"))
        tried = with_new.withColumn("at", F.row_number().over(first)).join(originals, taken, "left")
        state = written(
            tried.select("kind", "canonical", "attempt", "surrogate", ((F.col("at") > 1) | F.col("__c").isNotNull()).alias("clash")), "surrogates"
        )
        if state.where("clash").limit(1).count() == 0:
            return state.drop("clash")
        now = state.select("kind", "canonical", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def anonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``pii_types`` (array<string>, in order of the text) beside it."""
    found = written(entities(docs), "entities")
    later = assign(found, key).where("attempt > 0").select(F.col("kind").alias("__k"), F.col("canonical").alias("__c"), "attempt")
    given = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("text_hash"))
    own = "array<struct<kind:string,canonical:string,attempt:int>>"
    if later.limit(1).count():
        lists = (
            found.join(later, (F.col("kind") == F.col("__k")) & (F.col("canonical") == F.col("__c")))
            .groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"))
            .agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias("attempts"))
        )
        given = given.join(lists, F.col("doc.doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")), "left")
    else:
        given = given.withColumn("attempts", F.lit(None).cast(own))
    given = given.select("doc.*", F.col("attempts").alias("__attempts"))
    at, names = docs.columns.index("text"), docs.columns

    def scan(batches):
        for batch in batches:
            texts, types = [], []
            for t, a in zip(batch.column(at), batch.column(len(names))):
                t, a = t.as_py(), a.as_py()
                new, kinds = (t, []) if t is None else replace(t, {(x["kind"], x["canonical"]): x["attempt"] for x in a or ()}, key)
                texts.append(new)
                types.append([k.partition(":")[0].rstrip("+") for k in kinds])
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(types, pa.list_(pa.string()))], names=[*names, "pii_types"])

    return given.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("pii_types", T.ArrayType(T.StringType()))]))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    done = anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("pii_types").cast("long").alias("n_entities"), F.array_join("pii_types", ",").alias("types"), "text")
