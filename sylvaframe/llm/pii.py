"""PII surrogates: keyed, type-consistent replacements that keep format, script and gender.

Entities are found by patterns: e-mail and IPv4 addresses, phone and payment-card numbers, IBANs, keys and long hex or
mixed tokens, and person names: a known first name, a title, or words that introduce a person (``my name is``), before
capitalised words. In a text that names a person, the bare surname is an entity too, wherever it stands.

An entity is written in a normal form first, so that its spellings stay one: digits of a phone, card or account number
without what stands between them, mailboxes in lower case, and of a name the surname alone. The surrogate is drawn by a keyed
permutation of the normal form's format and written in the spelling's format: every character moves inside its class
(digits, hex digits, vowels and consonants of the same script and case; beyond those, letters of the same category and
Unicode block), card numbers keep their check digit valid, first names move inside the pool of their gender and script.
Because it is a permutation, equal entities get equal surrogates wherever they stand, and different ones different
surrogates.

Collision check: a surrogate may still equal an entity that really occurs. Those entities are found by a join of the
distinct entities with themselves, and drawn anew with further keys until the draw is no real entity and nobody else's
surrogate, so distinctness and coreference hold over the whole corpus. Where that fails ``DRAWS`` times the format is
crowded, and further draws are a character longer. A real entity is never given out.

Defined cases: a null text stays null and an empty one empty, with no entity; very long texts are scanned whole in linear
time; of overlapping entities the one that begins first counts, and of those the earlier pattern; equal rows give equal
results; a format with a single member is drawn longer; an empty table gives no rows; other columns are ignored
(``entities``) or kept (``replaced``).
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Collided entities up to this many travel with the tasks; beyond it they are joined.
BROADCAST_WALKED = 100_000
ROUNDS = 8
DRAWS = 16

FIRST_NAMES = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sofia Clara Elena Lucia Marta Alice Nina Sarah Mary Linda Susan Karen Emily Jane Louise Camille Ingrid Carmen Isabel Mei Priya Fatima Aisha Yuki Olga Katarzyna Hana Amina Leila".split(),
    ("latin", "m"): "John James Robert David Peter Paul Thomas Daniel Mark Martin Lucas Hugo Louis Karl Hans Otto Carlos Diego Pablo Jorge William George Henry Michael Wei Rahul Ahmed Omar Kenji Piotr Ivan Amit Hassan Mateo".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Дарья".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел Виктор Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Παύλος".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
#: Words that introduce a person's two names.
CUES = ("my name is", "My name is", "I am called", "signed by", "Signed by", "sincerely,", "Sincerely,", "regards,", "Regards,", "Dear", "written by", "Written by", "contact person:", "Contact person:")
_POOL = {name: pool for pool in FIRST_NAMES.values() for name in pool}
#: Character classes: a character is replaced inside the first class that holds it.
CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöü", "çñß", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ")
_CLASS = {c: k for k in CLASSES for c in k}


_SEEN: dict = {}


def _class(c: str) -> str | None:
    """What a character may become: its class, or the letters and digits of its category in its stretch of 64 code points.
    None for signs, which stay."""
    if c in _CLASS:
        return _CLASS[c]
    if c not in _SEEN:
        _SEEN[c] = _other_class(c)
    return _SEEN[c]


def _other_class(c: str) -> str | None:
    kind = unicodedata.category(c)
    if kind == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if kind[0] != "L":
        return None
    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == kind and unicodedata.normalize("NFC", x) == x and x not in _CLASS) or None

_HEX = "0123456789abcdef"

_CAP = r"[^\W\d_a-zà-ÿа-яα-ω][^\W\d_]+"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<hex>\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}\b)"
    r"|(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{12,16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}|\bsk-[A-Za-z0-9_-]{16,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<card>(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
)
NAMES = "|".join(map(re.escape, sorted([*TITLES, *_POOL, *CUES], key=len, reverse=True)))
#: Every entity but a name holds a digit, an at sign or a key's prefix; a name starts with a title or a known first name, or after a cue.
ANCHOR, NAME_ANCHOR = re.compile(r"[0-9@]|AKIA|ASIA|gh[pousr]_|sk-"), re.compile(rf"(?:{NAMES})(?![\w])")
NAME = re.compile(rf"(?:(?:{'|'.join(TITLES)})\.? (?:{_CAP} )?{_CAP}|(?:{'|'.join(sorted(_POOL, key=len, reverse=True))}) {_CAP})")
CUED = re.compile(rf"(?:{'|'.join(map(re.escape, CUES))})\s((?:(?:{'|'.join(TITLES)})\.? )?{_CAP} {_CAP})")
#: Letters of a surname that counts by itself, in texts that name the person.
ALONE = 4
#: How far from an anchor the patterns look at least.
REACH = 160


class Permutation:
    """A keyed permutation of range(n): Feistel rounds over the least square power of two, walked until inside."""

    def __init__(self, key: bytes):
        self.key = key

    def __call__(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        half = (max(2, (n - 1).bit_length()) + 1) // 2
        mask, salt = (1 << half) - 1, tweak.encode()
        while True:
            a, b = x >> half, x & mask
            for r in range(ROUNDS):
                n_bytes = (half + 7) // 8
                said = bytes([r]) + b.to_bytes(n_bytes, "big") + salt
                if n_bytes <= 56:
                    h = hashlib.blake2b(said, key=self.key, digest_size=n_bytes + 8).digest()
                else:
                    h = hashlib.shake_256(len(self.key).to_bytes(2, "big") + self.key + said).digest(n_bytes + 8)
                a, b = b, a ^ (int.from_bytes(h, "big") & mask)
            x = a << half | b
            if x < n:
                return x


def _move(text: str, sets: list[str | None], p: Permutation, tweak: str) -> str:
    """Permute the mixed-radix number that the movable characters write."""
    n = x = 0
    n = 1
    for c, s in zip(text, sets):
        if s:
            n *= len(s)
            x = x * len(s) + s.index(c)
    x = p(x, n, tweak)
    out = []
    for c, s in zip(reversed(text), reversed(sets)):
        if s:
            x, k = divmod(x, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def _shape(sets: list[str | None], text: str) -> str:
    return "|".join(s if s else c for c, s in zip(text, sets))


def luhn(digits: str) -> int:
    """The check sum of a card number; 0 where it is valid."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _card(text: str, p: Permutation) -> str:
    sets = [_class(c) for c in text]
    at = [i for i, s in enumerate(sets) if s]
    sets[at[0]] = None  # the issuer's digit stays
    valid = luhn("".join(text[i] for i in at)) == 0
    if valid:
        sets[at[-1]] = None
    while True:
        text = _move(text, sets, p, f"card{valid}{len(at)}{text[at[0]]}{''.join(c for c in text if not c.isdigit())}")
        digits = "".join(text[i] for i in at)
        if valid:
            check = (10 - luhn(digits[:-1] + "0")) % 10
            return text[: at[-1]] + str(check) + text[at[-1] + 1 :]
        if luhn(digits):
            return text


def _ip(text: str, p: Permutation) -> str:
    a = [int(x) for x in text.split(".")]
    inside = a[0] in (0, 10, 127)
    first = (0, 10, 127) if inside else tuple(x for x in range(1, 224) if x not in (0, 10, 127))
    if a[0] not in first:
        first = tuple(range(224, 256))
    x = p(((first.index(a[0]) * 256 + a[1]) * 256 + a[2]) * 256 + a[3], len(first) << 24, f"ip{first[0]}")
    return f"{first[x >> 24]}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"


def _word(text: str, p: Permutation, tweak: str) -> str:
    sets = [_class(c) for c in text]
    return _move(text, sets, p, tweak + _shape(sets, text))


def parts(kind: str, text: str) -> tuple[str, str]:
    """The kind and normal form under which an entity is drawn."""
    if kind == "name":
        return "surname", text.rsplit(" ", 1)[-1]
    if kind == "email":
        low = text.lower()
        return kind, low if len(low) == len(text) else text
    if kind == "phone":
        plus = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", text)
        return kind, (plus.group() + " " if plus else "") + re.sub(r"\D", "", text[plus.end() if plus else 0 :])
    if kind in ("card", "iban"):
        return kind, re.sub(r"[ -]", "", text)
    return kind, text


def rendered(kind: str, text: str, normal: str, p: Permutation) -> str:
    """An entity's surrogate in its own spelling. normal: the surrogate of its normal form."""
    if kind == "name":
        words = text.split(" ")
        if len(words) > 1 and not (len(words) == 2 and words[0].rstrip(".") in TITLES):
            at, first = len(words) - 2, words[-2]
            pool = _POOL.get(first)
            # the surname is the tweak, so that one first name doesn't give another away
            words[at] = pool[p(pool.index(first), len(pool), f"{pool[0]} {words[-1]}")] if pool else _word(first, p, "first" + words[-1])
        return " ".join([*words[:-1], normal])
    if kind == "email":
        return "".join(b.upper() if a.isupper() and len(b.upper()) == 1 else b for a, b in itertools.zip_longest(text, normal, fillvalue="") if b)
    if kind in ("phone", "card", "iban"):
        new = iter(normal.replace(" ", "").lstrip("+"))
        out = "".join(next(new, "") if c.isalnum() else c for c in text)
        return out + "".join(new)
    return normal


def surrogate(kind: str, text: str, p: Permutation) -> str:
    """One application of the keyed permutation to an entity, written in its spelling."""
    own, normal = parts(kind, text)
    return rendered(kind, text, drawn(own, normal, p), p)


def drawn(kind: str, text: str, p: Permutation) -> str:
    """One application of the keyed permutation of a normal form's format."""
    if kind == "card":
        return _card(text, p)
    if kind == "ip":
        return _ip(text, p)
    if kind == "hex":
        return _move(text, [_HEX] * len(text), p, f"hex{len(text)}")
    if kind == "email":
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        # the registered name and its ending stay, as format; what stands before them moves with the local part
        keep = ".".join(labels[-2:])
        front = local + "@" + "".join(x + "." for x in labels[:-2])
        return _word(front, p, f"email{keep}") + keep
    keep = {"key": 4, "iban": 2}.get(kind, 0)
    if kind == "phone" and text.startswith("+"):
        keep = text.index(" ")
    return text[:keep] + _word(text[keep:], p, f"{kind}{text[:keep]}")


def longer(kind: str, text: str, by: int) -> str:
    """A text of the entity's format with further characters, for formats that are full."""
    if kind in ("ip", "card"):
        return text  # these have too many members to be full
    if kind == "email":
        local, _, domain = text.rpartition("@")
        return local + "a" * by + "@" + domain
    return text + (text[-1] if _class(text[-1]) else "a") * by


def find(text: str):
    """(kind, start, end) of each entity, left to right. Patterns run around anchors only; one search finds those."""
    found, end = [], 0
    regions = []
    for m in ANCHOR.finditer(text):
        at = m.start()
        if at < end - REACH // 2:
            continue
        if not regions or at - REACH > regions[-1][1]:
            regions.append([max(0, at - REACH), 0])
        end = regions[-1][1] = at + REACH
    # whole words only, so that a region never cuts an entity without spaces; those that meet are one
    wide: list[list[int]] = []
    for a, b in regions:
        last = wide[-1][1] if wide else 0
        if a > last:
            a = text.rfind(" ", last, a) + 1 or last
        if b > last:
            b = text.find(" ", b)
            b = b if b >= 0 else len(text)
        if wide and a <= last:
            wide[-1][1] = max(last, b)
        else:
            wide.append([a, b])
    for a, b in wide:
        found += [(m.lastgroup, m.start(), m.end()) for m in PATTERN.finditer(text, a, b)]
    names, at = [], 0
    for m in NAME_ANCHOR.finditer(text):
        if m.start() < at or (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")):
            continue
        if x := NAME.match(text, m.start()):
            names.append(("name", x.start(), x.end()))
            at = x.end()
        elif x := CUED.match(text, m.start()):
            names.append(("name", x.start(1), x.end(1)))
            at = x.end()
    if names:
        # the surnames of the persons named stand for them alone, too
        known = {w for _, a, b in names if len(w := text[a:b].rsplit(" ", 1)[-1]) >= ALONE}
        if known:
            alone = re.compile(rf"(?<![\w])(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?![\w])")
            inside = [(a, b) for _, a, b in names]
            k = 0
            for m in alone.finditer(text):
                while k < len(inside) and inside[k][1] <= m.start():
                    k += 1
                if k == len(inside) or m.end() <= inside[k][0]:
                    names.append(("name", m.start(), m.end()))
    if not names:
        return found
    out, end = [], 0
    for x in sorted(found + names, key=lambda x: x[1]):
        if x[1] >= end:
            out.append(x)
            end = x[2]
    return out


def entities(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Distinct (kind, value) of the corpus, in normal form."""

    def run(batches):
        for pdf in batches:
            found = {parts(k, t[a:b]) for t in pdf["text"] if t for k, a, b in find(t)}
            yield pd.DataFrame(sorted(found), columns=["kind", "value"])

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "kind string, value string").distinct()


def _drawn(values: DataFrame, key: bytes, column: str, by: int = 0) -> DataFrame:
    """values with a column ``to``: the permutation applied to ``column``, made longer by so many characters."""

    @F.pandas_udf("string")
    def draw(kind: pd.Series, value: pd.Series) -> pd.Series:
        p = Permutation(key)
        return pd.Series([drawn(k, longer(k, v, by) if by else v, p) for k, v in zip(kind, value)], dtype=object)

    return values.withColumn("to", draw("kind", column))


def walked(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, to) of the entities whose surrogate is a real entity: the first of further keyed draws that is no
    real entity and nobody else's surrogate. values: stored distinct entities in normal form. After DRAWS draws the format
    counts as crowded, and draws get longer."""
    taken = values.select(F.col("value").alias("__v")).distinct()
    first = stored(_drawn(values, key, "value"), "drawn")
    used = first.select(F.col("to").alias("__v"))
    open_ = stored(first.join(taken, F.col("to") == F.col("__v"), "left_semi").select("kind", "value"), "collided")
    done = first.limit(0)
    for t in itertools.count(1):
        if open_.isEmpty():
            break
        again = stored(_drawn(open_, hashlib.blake2b(b"%d" % t, key=key[:64]).digest(), "value", max(0, -(-(t - DRAWS) // DRAWS))), "again")
        free = again.join(taken, F.col("to") == F.col("__v"), "left_anti").join(used, F.col("to") == F.col("__v"), "left_anti")
        free = free.join(done.select(F.col("to").alias("__v")), F.col("to") == F.col("__v"), "left_anti")
        won = free.groupBy("to").agg(F.min(F.struct("kind", "value")).alias("x")).select("x.kind", "x.value", "to")
        done = stored(done.unionByName(won), "redrawn")
        open_ = stored(open_.join(done.select(F.col("kind").alias("__k"), F.col("value").alias("__v")), (F.col("value") == F.col("__v")) & (F.col("kind") == F.col("__k")), "left_anti"), "collided")
    return done


def replaced(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """id, the scrubbed text, n_entities and kinds (the kinds replaced, in order of place)."""
    spark = docs.sparkSession
    values = stored(entities(docs, text_col=text_col), "entities")
    moved = walked(values, key)
    n = moved.count()
    kept = [c for c in keep if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)])
    if n <= BROADCAST_WALKED:
        own = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["to"] for r in moved.collect()})
        rows = rows.withColumn("__own", F.lit(None).cast("map<string,string>"))
    else:
        own = None
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
        rows = stored(rows, "rows")

        def held(batches):
            for pdf in batches:
                x = [(r, *parts(k, t[a:b])) for r, t in zip(pdf["__row"], pdf["__text"]) if t for k, a, b in find(t)]
                yield pd.DataFrame(sorted(set(x)), columns=["row", "kind", "value"])

        uses = rows.select("__row", "__text").mapInPandas(held, "row long, kind string, value string").join(moved, ["kind", "value"])
        maps = uses.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "value").alias("k"), "to"))).alias("__own"))
        rows = rows.join(maps, F.col("__row") == F.col("row"), "left").drop("__row", "row")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    carry = ["__id", *[f"__k{i}" for i in range(len(kept))]]

    def run(batches):
        p = Permutation(key)
        for pdf in batches:
            texts, counts, kinds = [], [], []
            for t, m in zip(pdf["__text"], pdf["__own"]):
                if not t:
                    texts.append(t)
                    counts.append(0)
                    kinds.append([])
                    continue
                m = dict(m) if m is not None else {}
                out, at, seen = [], 0, []
                for kind, a, b in find(t):
                    v = t[a:b]
                    base, normal = parts(kind, v)
                    to = own.value.get((base, normal)) if own is not None else m.get(f"{base} {normal}")
                    out += [t[at:a], rendered(kind, v, drawn(base, normal, p) if to is None else to, p)]
                    at = b
                    seen.append(kind)
                texts.append("".join(out) + t[at:])
                counts.append(len(seen))
                kinds.append(seen)
            yield pdf[carry].assign(text=pd.Series(texts, dtype=object, index=pdf.index), n_entities=counts, kinds=pd.Series(kinds, dtype=object, index=pdf.index))

    out = rows.mapInPandas(run, ", ".join([*[f"{c} {types[c]}" for c in carry], "text string", "n_entities long", "kinds array<string>"]))
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], F.col("text").alias(text_col), "n_entities", "kinds")
