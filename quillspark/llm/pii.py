"""Personal data: detection and keyed, type-consistent surrogates.

Detected entities are replaced by surrogates drawn from a keyed hash of the entity's normal form: e-mail
and network addresses, phone, card, social security, bank account and passport numbers, street
addresses, and names that follow a form of address or a phrase like "my name is". Within a text the
family name and the full name are then found without it too.

The same entity gets the same surrogate everywhere, however it is written (coreference): phone numbers
with and without the country code 1 are one, and names are drawn word by word, so "Mr. John Smith",
"Dr. Smith" and "Smith" share the family name's surrogate. A surrogate keeps the kind, the layout, the
script and, for given names, the gender that the text tells.

Different entities keep different surrogates: candidates are checked over the whole corpus against
each other and against the entities that really occur; those that collide draw again until none
does, from a space that grows where the format allows it; else it raises. Only entities that had to
draw again (``redrawn``) are looked up when texts are rewritten; for all others the first draw is
computed where the text lies.

Defined cases: null and empty texts come back as empty texts without entities; texts are rewritten
whole; overlapping finds are resolved to the leftmost, then longest; repeated rows are rewritten
alike; rows with a null doc_id are rewritten too; an empty table gives an empty result; other
columns come back as they are, but one called entities is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join, staged, tidied

MAX_DRAWS = 200
#: Draws after which mail addresses and names grow by a character or syllable.
WIDEN = 6
KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "passport", "address", "name")


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    norm: str


_EMAIL = re.compile(r"(?<![\w.+-])[^\W_][\w.+-]{0,63}@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?![\w-])")
#: Whole runs of all characters that the four patterns of numbers can match, so what surrounds a
#: run decides in those patterns only. Seven characters are the shortest address.
_DIGITS = re.compile(r"[+(]?\d[\d ().+-]{6,}")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")
_CARD = re.compile(r"(?<!\d)[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\d)|(?<!\d)3[47]\d{2}([ -]?)\d{6}\2\d{5}(?!\d)")
_SSN = re.compile(r"(?<![\d-])(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
_PHONE = re.compile(r"(?<!\d)(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)")
#: Forms of address by the gender that they tell.
TITLES = {
    "m": "Mr Herr Herrn Monsieur Señor Sr Г-н Господин".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Srta Г-жа Госпожа".split(),
    "n": "Dr Prof".split(),
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_WORD = r"[^\W\d_a-zà-ÿа-яά-ώ][^\W\d_]+"
_NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(_GENDER, key=len, reverse=True))})\.? ({_WORD}(?:[ -]{_WORD})*)(?!\w)")
#: Phrases that a name follows.
CUES = "my name is|name is|mein name ist|ich heiße|je m'appelle|mon nom est|me llamo|mi nombre es|меня зовут"
_CUED = re.compile(rf"(?<!\w)(?i:{CUES}) ({_WORD}(?:[ -]{_WORD}){{0,3}})(?!\w)")
_PASSPORT = re.compile(r"(?i:passport|reisepass|passeport|pasaporte)(?i: (?:no|number|nr|nummer|numéro|número))?[.:]? ?#?([A-Z]{1,2}\d{6,8})(?!\w)")
#: Kinds of streets, before the name, after it, or at its end.
STREETS = {"after": "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square", "before": "rue|avenue|boulevard|place|Calle|Avenida|Plaza|Paseo", "end": "straße|strasse|weg|platz|allee|gasse"}
_STREET = re.compile(
    rf"(?<!\w)\d{{1,5}} (?:{_WORD} ){{1,3}}(?:{STREETS['after']})(?!\w)|(?<!\w)\d{{1,4}},? (?:{STREETS['before']}) (?:de la |du |des |de |d')?{_WORD}(?: {_WORD})?(?!\w)"
    rf"|(?<!\w)(?:{STREETS['before']}) (?:de la |del |de )?{_WORD}(?: {_WORD})?,? \d{{1,4}}(?!\w)|(?<!\w){_WORD}(?:{STREETS['end']}) \d{{1,4}}[a-z]?(?!\w)"
)
#: What every mention of a passport holds, and every address.
_PASSES = ("assport", "asseport", "asaporte", "eisepass", "ASSPORT", "ASSEPORT", "ASAPORTE", "EISEPASS")
_HOUSE = re.compile(r"(?<!\w)\d{1,5}[a-z]?(?!\w)")
_STREET_WORDS = {w.lower() for k in ("after", "before") for w in STREETS[k].split("|")} | {"de", "la", "du", "des", "del", "d"}
_LETTER_RUN = re.compile(r"[^\W\d_]+")
#: Syllables that names are made of, and their endings by gender, by script.
SYLLABLES = {
    "latin": ("ba be bo da de do fa fi ga go ka ke ki la le li lo ma me mi mo na ne ni no pa po ra re ri ro sa se si so ta te ti to va ve vi".split(), {"m": "n r s".split(), "f": "a ia".split(), "n": "l m".split()}),
    "cyrillic": ("ба бе бо да де до га го ка ке ки ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се си со та те ти то ва ве ви".split(), {"m": "н р с".split(), "f": "а ия".split(), "n": "л м".split()}),
    "greek": ("βα βε βο δα δε δο κα κε κι λα λε λι λο μα με μι μο να νε νι νο πα πο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(), {"m": "ς ν".split(), "f": "α ια".split(), "n": "λ μ".split()}),
}
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def script_of(text: str) -> str:
    """The script of a text's first letter of a known script; Latin otherwise."""
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if c.isalpha():
            return "latin"
    return "latin"


def alphabet(letter: str) -> str:
    """Letters among which one may be exchanged: those of its script, or of its block of the same case."""
    if script_of(letter) != "latin" or ord(letter) < 0x250:
        return _LETTERS[script_of(letter)]
    low = ord(letter) & ~63
    return "".join(c for c in map(chr, range(low, low + 64)) if c.isalpha() and c.isupper() == letter.isupper()) or letter


def _luhn(digits: str) -> int:
    """The check digit for digits without one."""
    total = sum(d if i % 2 else d // 5 + d * 2 % 10 for i, d in enumerate(int(c) for c in reversed(digits)))
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _is_iban(compact: str) -> bool:
    return 15 <= len(compact) <= 34 and _mod97(compact[4:] + compact[:4]) == 1


def _name_norm(gender: str, name: str) -> str:
    """Words of a name with what they are: given names with the gender told, and the family name."""
    words = _LETTER_RUN.findall(name.casefold())
    return " ".join([f"{gender}:{w}" for w in words[:-1]] + [f"s:{w}" for w in words[-1:]])


def _names(text: str) -> list[Entity]:
    told = [(m.start(2), m.group(2), _GENDER[m.group(1)]) for m in _NAME.finditer(text)]
    low = text.lower()
    if any(cue in low for cue in CUES.split("|")):
        told += [(m.start(1), m.group(1), "n") for m in _CUED.finditer(text)]
    if not told:
        return []
    genders: dict[str, set[str]] = {}
    for _, name, gender in told:
        for w in _LETTER_RUN.findall(name.casefold())[:-1]:
            genders.setdefault(w, set()).add(gender)
    # a given name told with one gender has it wherever the text tells none
    known = {w: (g - {"n"}).pop() if len(g - {"n"}) == 1 else "n" for w, g in genders.items()}

    def norm(gender: str, name: str) -> str:
        parts = _name_norm(gender, name).split(" ")
        return " ".join(f"{known.get(p[2:], 'n')}:{p[2:]}" if p[0] == "n" else p for p in parts)

    found = [Entity(at, at + len(name), "name", norm(gender, name)) for at, name, gender in told]
    bare = {}
    for _, name, gender in told:
        last = _LETTER_RUN.findall(name)[-1]
        bare[name] = bare[name.upper()] = norm(gender, name)
        if len(last) > 2:
            for form in (last, last.upper()):
                bare.setdefault(form, f"s:{last.casefold()}")
    again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(bare, key=len, reverse=True)))})(?!\w)")
    return found + [Entity(*m.span(), "name", bare[m.group()]) for m in again.finditer(text)]


def detect(text: str) -> list[Entity]:
    """Entities in order, none overlapping."""
    found: list[Entity] = []
    if "@" in text:
        found += [Entity(*m.span(), "email", m.group().lower()) for m in _EMAIL.finditer(text)]
    for run in _DIGITS.finditer(text):
        lo, hi = run.span()
        used = bytearray(hi - lo)
        # each kind takes what the ones before left of the run
        for kind, pattern in (("ip", _IP), ("ssn", _SSN), ("card", _CARD), ("phone", _PHONE)):
            for m in pattern.finditer(text, lo, hi):
                a, b = m.span()
                if any(used[a - lo : b - lo]):
                    continue
                norm = m.group() if kind == "ip" else re.sub(r"\D", "", m.group())
                if kind == "phone" and not 7 <= len(norm) <= 15:
                    continue
                if kind == "card" and not 13 <= len(norm) <= 19:
                    continue
                used[a - lo : b - lo] = b"\1" * (b - a)
                if kind == "phone" and len(norm) == 11 and norm[0] == "1":
                    norm = norm[1:]
                found.append(Entity(a, b, kind, norm))
    for m in _IBAN.finditer(text):
        compact = m.group().replace(" ", "")
        if _is_iban(compact):
            found.append(Entity(*m.span(), "iban", compact))
    if any(word in text for word in _PASSES):
        found += [Entity(*m.span(1), "passport", m.group(1)) for m in _PASSPORT.finditer(text)]
    # a street address lies around a number
    near = {m for n in _HOUSE.finditer(text) for m in (a.span() for a in _STREET.finditer(text, max(0, n.start() - 80), n.end() + 80))}
    found += [Entity(a, b, "address", " ".join(re.findall(r"\w+", text[a:b].casefold()))) for a, b in near]
    found += _names(text)
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, -e.end, e.kind)):
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


class Draw:
    """A stream of choices from a keyed hash of kind, normal form and number of the draw."""

    def __init__(self, key: bytes, kind: str, norm: str, draw: int):
        self.state = int.from_bytes(hmac.new(key, f"{kind}\0{norm}\0{draw}".encode(), hashlib.sha512).digest(), "big")

    def below(self, n: int) -> int:
        self.state, value = divmod(self.state, n)
        return value

    def like(self, text: str) -> str:
        """Letters for letters of the same script and case, digits for digits, the rest as it is."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                letters = alphabet(c)
                new = letters[self.below(len(letters))]
                out.append(new.upper() if c.isupper() else new)
            else:
                out.append(c)
        return "".join(out)


def _syllabic(d: Draw, word: str, ends_: str, draw: int) -> str:
    syllables, ends = SYLLABLES[script_of(word)]
    return "".join(syllables[d.below(len(syllables))] for _ in range(max(2, min(4, len(word) // 2)) + draw // WIDEN)) + ends[ends_][d.below(len(ends[ends_]))]


def surrogate(key: bytes, kind: str, norm: str, draw: int = 0) -> str:
    """The normal form of an entity's surrogate; of a name that of one word (with its prefix)."""
    d = Draw(key, kind, norm, draw)
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        host, _, _ = domain.rpartition(".")
        # the domain draws by itself, so addresses of one domain stay together; its end is reserved
        return f"{d.like(local)}{d.like('0' * (draw // WIDEN))}@{Draw(key, 'domain', domain, 0).like(host)}.example"
    if kind == "ip":
        o = [int(x) for x in norm.split(".")]
        private = o[0] == 10 or o[:2] == [192, 168] or o[0] == 172 and 16 <= o[1] < 32
        new = [10 if private else o[0]] + [d.below(254) + 1 for _ in range(3)]
        if not private and o[0] != 127:
            public = [x for x in range(11, 224) if x not in (100, 127, 169, 172, 192, 198, 203)]
            new[0] = public[d.below(len(public))]
        return ".".join(map(str, new))
    if kind == "card":
        body = norm[0] + d.like(norm[1:-1])
        valid = _luhn(norm[:-1]) == int(norm[-1])
        return body + str((_luhn(body) + (0 if valid else 1 + d.below(9))) % 10)
    if kind == "phone":
        new = d.like(norm)
        if len(norm) == 10:  # area and exchange do not start with 0 or 1
            return f"{2 + int(new[0]) % 8}{new[1:3]}{2 + int(new[3]) % 8}{new[4:]}"
        return (norm[:2] if len(norm) > 10 else "") + new[2 if len(norm) > 10 else 0 :]
    if kind == "ssn":
        return f"{900 + d.below(100)}{d.below(99) + 1:02}{d.below(9999) + 1:04}"
    if kind == "iban":
        body = d.like(norm[4:])
        return f"{norm[:2]}{98 - _mod97(f'{body}{norm[:2]}00'):02}{body}"
    if kind == "passport":
        return d.like(norm)
    if kind == "address":
        ends = [e for e in STREETS["end"].split("|")]
        out = []
        for w in norm.split(" "):
            end = next((e for e in ends if w.endswith(e)), "")
            if w[0].isdigit():
                digits = w.rstrip("abcdefghijklmnopqrstuvwxyz")
                out.append(str(1 + d.below(9)) + d.like(digits[1:]) + w[len(digits) :])
            else:
                out.append(w if w in _STREET_WORDS else _syllabic(d, w, "n", draw) + end)
        return " ".join(out)
    role, _, word = norm.partition(":")
    return f"{role}:{_syllabic(d, word, role if role in 'mf' else 'n', draw)}"


def parts(kind: str, norm: str) -> list[str]:
    """What draws by itself: the words of a name, all else whole."""
    return norm.split(" ") if kind == "name" else [norm]


def _cased(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new


def written(kind: str, new: list[str], old: str) -> str:
    """Surrogates' normal forms in the layout of the text that they replace."""
    if kind == "name":
        words = iter(w.partition(":")[2] for w in new)
        return _LETTER_RUN.sub(lambda m: _cased(next(words, ""), m.group()), old)
    if kind == "address":
        words = iter(new[0].split(" "))
        return re.sub(r"\w+", lambda m: _cased(next(words, ""), m.group()), old)
    if kind in ("email", "ip"):
        return new[0].upper() if old.isupper() else new[0]
    digits = sum(c.isalnum() for c in old)
    chars = iter("1" * (digits - len(new[0])) + new[0] if kind == "phone" else new[0])
    return "".join(next(chars, "") if c.isalnum() else c for c in old)


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        raw = value.as_buffer()
        yield "" if raw is None else raw.to_pybytes().decode("utf-8", "replace")


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("norm", pa.string())]))
    for got in batches:
        out = [[{"kind": e.kind, "norm": n} for e in detect(t) for n in parts(e.kind, e.norm)] for t in _texts(got.column(1))]
        yield pa.RecordBatch.from_arrays([got.column(0), pa.array(out, kind)], names=["doc_id", "found"])


def _draws(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = zip(*(got.column(i).to_pylist() for i in range(3)))
            new = [surrogate(key, *row) for row in rows]
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(new, pa.string())], names=["kind", "norm", "draw", "new"])

    return run


def redrawn(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, norm and draw of the entities (kind, norm; no repeats) whose first draw collides with
    an entity or with another's surrogate. Of equal candidates the smallest entity keeps it."""
    spark = entities.sparkSession
    schema = "kind string, norm string, draw int, new string"
    waiting, taken, done = entities, None, []
    for draw in range(MAX_DRAWS):
        drawn = waiting.select("kind", "norm", F.lit(draw).alias("draw")).mapInArrow(_draws(key), schema)
        drawn = staged(drawn.join(entities.select("kind", F.col("norm").alias("new"), F.lit(True).alias("real")), ["kind", "new"], "left").select("kind", "norm", "draw", "new", "real"), "drawn")
        free = drawn.where("real IS NULL")
        if taken is not None:
            free = free.join(taken.select("kind", "new"), ["kind", "new"], "left_anti")
        first = free.groupBy("kind", "new").agg(F.min("norm").alias("norm"))
        given = staged(first.select("kind", "norm", "new", F.lit(draw).alias("draw")), "given")
        if draw:
            done.append(given.select("kind", "norm", "draw"))
        taken = given if taken is None else staged(taken.unionByName(given), "taken")
        waiting = staged(drawn.join(given.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm"), "waiting")
        if not waiting.limit(1).count():
            break
    else:
        raise RuntimeError("surrogates keep colliding: their space is too small")
    out = spark.createDataFrame([], "kind string, norm string, draw int")
    for d in done:
        out = out.union(d)
    return out


def _rewriter(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for got in batches:
            texts, spans = [], []
            for text, draws in zip(_texts(got.column(1)), got.column(2).to_pylist()):
                again = {(d["kind"], d["norm"]): d["draw"] for d in draws or ()}
                out, at, own = [], 0, []
                for e in detect(text):
                    new = [surrogate(key, e.kind, n, again.get((e.kind, n), 0)) for n in parts(e.kind, e.norm)]
                    out += [text[at : e.start], written(e.kind, new, text[e.start : e.end])]
                    at = e.end
                    own.append({"kind": e.kind, "start": e.start, "end": e.end})
                texts.append("".join([*out, text[at:]]))
                spans.append(own)
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["key", "text", "entities"])

    return run


def pseudonymized(docs: DataFrame, key: bytes) -> DataFrame:
    """The columns of ``docs`` with text rewritten, and ``entities``: array of kind, start, end
    (code points of the old text). The key is a secret: who has it can tell which surrogate belongs
    to a guessed entity."""
    docs = docs.drop("entities")
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("key"), F.col("text").cast("string").alias("text"))
    of = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(_entities), f"doc_id {of}, found array<struct<kind:string,norm:string>>")
    found = staged(found.where(F.size("found") > 0).select("doc_id", F.explode("found").alias("e")).select("doc_id", "e.kind", "e.norm"), "found")
    again = staged(redrawn(staged(found.select("kind", "norm").distinct(), "entities"), key), "redrawn")
    none = F.lit(None).cast("array<struct<kind:string,norm:string,draw:int>>").alias("draws")
    if again.limit(1).count():
        by_doc = sized_join(found, again, ["kind", "norm"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "norm", "draw")).alias("draws"))
        by_doc = staged(by_doc.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "draws"), "draws")
        rows = sized_join(rows.withColumn("id", F.coalesce(F.col("key.doc_id").cast("string"), F.lit(""))), by_doc, ["id"], "left").select("key", "text", "draws")
    else:
        rows = rows.select("key", "text", none)
    kind = dict(rows.dtypes)["key"]
    out = rows.mapInArrow(tidied(_rewriter(key)), f"key {kind}, text string, entities array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(*[F.col(f"key.`{c}`").alias(c) if c != "text" else F.col("text") for c in docs.columns], "entities")
