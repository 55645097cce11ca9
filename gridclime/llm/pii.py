"""Surrogates for personal data: keyed, of the same type, format, gender and script, distinct and the same everywhere."""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables

#: Overrides that are sent to every task; more are joined to the documents that need them.
BROADCAST_ROWS = 100_000

# fixed values: titles that stand before names, by gender
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur M Señor Sr Don Signor господин г-н",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Srta Doña Signora госпожа г-жа",
    "n": "Dr Prof Professor Doktor",
}
# fixed values: given names by script and gender
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Paul Mark Peter Martin Hans Karl Jürgen Klaus Pierre Jean Louis Luc Carlos José Juan Luis Miguel Pablo".split(),
    ("latin", "f"): "Mary Anna Linda Susan Sarah Karen Laura Emma Julia Claudia Petra Ursula Monika Marie Claire Sophie Camille Carmen María Lucía Elena Isabel Rosa Teresa Alice Nora".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Павел".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
SYLLABLES = {
    "latin": "ba be bi bo da de do fa fe ga ge ha he ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve wa we za zo".split(),
    "cyrillic": "ба бе бо ва ве го да де до ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split(),
}
GENDER = {name.casefold(): g for (_, g), names in GIVEN.items() for name in names}
_TITLE_GENDER = {t.casefold(): g for g, ts in TITLES.items() for t in ts.split()}
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_UPPER = r"(?=[A-ZÀ-ÖØ-ÞА-ЯЁ])"
#: A word of a name, or an initial before one.
_PART = r"(?:[A-ZÀ-ÖØ-ÞА-ЯЁ]\.(?= [A-ZÀ-ÖØ-ÞА-ЯЁ])|" + _UPPER + _NAME + ")"
_GIVEN = "|".join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True))
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts.split()), key=len, reverse=True))
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?<=[=:] [\"'])[A-Za-z0-9+/_-]{20,}(?=[\"'])|(?<=[=:][\"'])[A-Za-z0-9+/_-]{20,}(?=[\"'])"
    r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w])(?:\d[ -]?){12,18}\d(?!\w))"
    r"|(?P<name>(?<!\w)(?:(?:" + _TITLE + r")\.? )+" + _PART + r"(?: " + _PART + r"){0,2})"
    # a given name, more of them or initials, and a capitalised word
    r"|(?P<person>(?<!\w)" + _UPPER + r"(?:" + _GIVEN + r")(?:-" + _UPPER + r"[^\W\d_]+)?"
    r"(?: (?:(?:" + _GIVEN + r")(?!\w)|[A-ZÀ-ÖØ-ÞА-ЯЁ]\.)){0,3} " + _UPPER + _NAME + r")"
)
_TITLES = re.compile(r"(?:(?:" + _TITLE + r")\.? )+" + _UPPER)
_WORD = re.compile(_NAME)
_BARE = re.compile(r"(?<!\w)" + _UPPER + _NAME)
#: Some character, run or word of each of the above, for a quick test of a text: each secret has a run of 20.
QUICK = (
    r"[\p{Nd}@]|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"
    r"|(?<!\w)(?=[\p{Lu}г])(?:(?:" + _TITLE + r")\.? \p{Lu}|(?:" + _GIVEN + r")[ -]\p{Lu})"
)


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[::-2]) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def card_end(s: str) -> int:
    """Length of the longest valid card number with which a run of digits, spaces and hyphens begins, or 0."""
    for m in reversed(list(re.finditer(r"\d+", s))):
        digits = digits_of(s[: m.end()])
        if 13 <= len(digits) <= 19 and luhn(digits) and re.match(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)", digits):
            return m.end()
    return 0


def digits_of(s: str) -> str:
    return "".join(str(int(c)) for c in s if c.isdecimal())


def candidates(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, text) of what PATTERN finds and the digits confirm; from what they do not, the search goes on."""
    at = 0
    while m := PATTERN.search(text, at):
        kind, a, b = m.lastgroup, m.start(), m.end()
        if kind == "card":
            b = a + card_end(m.group())
        elif kind == "phone" and not 7 <= len(digits_of(m.group())) <= 15:
            b = a
        if b > a:
            yield a, b, kind, text[a:b]
        at = max(b, a + 1)


def name_parts(s: str, titled: bool) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, value) of the given names and the surname of a name; initials stay."""
    at, gender = 0, "n"
    if titled:
        at = _TITLES.match(s).end()
        gender = next((g for t in s[:at].split() if (g := _TITLE_GENDER.get(t.rstrip(".").casefold(), "n")) != "n"), "n")
    parts = [(p.start(), p.end()) for p in _WORD.finditer(s, at) if s[p.end() : p.end() + 1] != "."]
    for x, y in parts:
        if s[y - 2 : y] in ("'s", "’s"):
            y -= 2
        p = s[x:y].casefold()
        own = GENDER.get(p) or GENDER.get(p.split("-")[0])
        if x != parts[-1][0] or p in GENDER:
            g = gender if gender != "n" else own or "n"
            yield x, y, "given-" + (g if g != "n" else "fm"[len(p) % 2]), p
        else:
            yield x, y, "surname", p


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, value) of the entities of a text. The value is what one entity has in all its forms.

    Given names and surnames are entities of their own, so a person with and without the given name stays one person.
    A name is found behind a title, or as a listed given name before a capitalised word; its parts are then found
    wherever they stand capitalised in the same text.
    """
    out, people = [], {}
    for a, b, kind, s in candidates(text):
        if kind in ("card", "phone", "ssn"):
            out.append((a, b, kind, digits_of(s)))
        elif kind == "email":
            out.append((a, b, "email", s.casefold()))
        elif kind in ("name", "person"):
            for x, y, k, p in name_parts(s, kind == "name"):
                # the first mention says what a part is
                k = people.setdefault(p, k)
                out.append((a + x, a + y, k, p))
        else:
            out.append((a, b, kind, s))
    if people:
        # spans found above do not overlap: a word is free if the last one that begins before its end ends before it
        starts, ends = [x[0] for x in out], [x[1] for x in out]
        for m in _BARE.finditer(text):
            word = m.group()
            whole = word[:-2] if word.endswith(("'s", "’s")) else word
            pieces = [(0, whole)] if whole.casefold() in people else [(p.start(), p.group()) for p in re.finditer(r"[^\W\d_]+", word)]
            for x, p in pieces:
                a, b, v = m.start() + x, m.start() + x + len(p), p.casefold()
                if len(p) > 1 and p[0].isupper() and v in people:
                    i = bisect_left(starts, b) - 1
                    if i < 0 or ends[i] <= a:
                        out.append((a, b, people[v], v))
        out.sort()
    yield from out


class Draws:
    """Pseudorandom numbers from a key, an entity and the number of the attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.block, self.pool = key, f"{kind}\0{value}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n

    def like(self, s: str) -> str:
        """A string of the same kinds of characters."""
        hexadecimal = re.fullmatch(r"[0-9a-f]{32,}", s) is not None
        out = []
        for c in s:
            if hexadecimal:
                out.append("0123456789abcdef"[self.below(16)])
            elif "0" <= c <= "9":
                out.append(chr(48 + self.below(10)))
            elif "a" <= c <= "z":
                out.append(chr(97 + self.below(26)))
            elif "A" <= c <= "Z":
                out.append(chr(65 + self.below(26)))
            else:
                out.append(c)
        return "".join(out)


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The value that stands for an entity; later attempts draw anew, names also from longer ones.

    Private addresses keep their private parts at first; where so many are in use that attempts fail, they keep fewer.
    """
    d = Draws(key, kind, value, attempt)
    if kind == "card":
        body = value[0] + d.like(value[1:-1])
        if value[0] in "235":  # the issuer's prefix decides what a valid card is
            body = value[:2] + body[2:]
        if value[0] == "6":
            body = value[:4] + body[4:]
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "phone":
        country = max(0, len(value) - 10)
        return value[:country] + str(2 + d.below(8)) + d.like(value[country + 1 :])
    if kind == "ssn":
        return "9" + d.like(value[1:])
    if kind == "ip":
        parts = value.split(".")
        keep = 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] else 0
        keep = max(0, keep - attempt // 2)
        drawn = [str(d.below(256)) for _ in parts[keep:]]
        if not keep:
            drawn[0] = str([x for x in range(11, 224) if x not in (127, 169, 172, 192)][d.below(209)])
        return ".".join(parts[:keep] + drawn)
    if kind == "email":
        local, domain = value.split("@")
        host, _, top = domain.rpartition(".")
        more = "".join(chr(97 + d.below(26)) for _ in range(max(0, 6 - len(local)) * (attempt > 0) + attempt // 4))
        return f"{d.like(local)}{more}@{d.like(host)}.example"
    if kind.startswith("given"):
        names = GIVEN[script_of(value), kind[-1]]
        return "-".join(names[d.below(len(names))] for _ in range(1 + (attempt + 1) // 2)).casefold()
    if kind == "surname":
        syllables = SYLLABLES[script_of(value)]
        return "".join(syllables[d.below(len(syllables))] for _ in range(max(3, min(6, len(value) // 2)) + attempt // 4))
    return d.like(value)


def dress(form: str, kind: str, new: str) -> str:
    """A surrogate value in the form, spacing and case of the text it replaces."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in form)
    if kind in ("email", "surname") or kind.startswith("given"):
        if form.isupper():
            return new.upper()
        if form[:1].isupper() and kind != "email":
            return re.sub(r"(^|[-'’])(\w)", lambda m: m[1] + m[2].upper(), new)
    return new


def override_table(found: DataFrame, key: bytes, tables: Tables) -> DataFrame:
    """(type, value, surrogate) of the entities that cannot keep their first draw.

    A draw is taken if no other entity of its type with a smaller value has drawn it and no entity of the corpus is
    written so; the rest draw again until none is left. found: distinct (type, value).
    """

    def draw(df: DataFrame, attempt: int) -> DataFrame:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [surrogate(key, k, v, attempt) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], ["type", "value", "surrogate"])

        return df.select("type", "value").mapInArrow(one, "type string, value string, surrogate string")

    real = found.select(F.col("type").alias("t"), F.col("value").alias("surrogate"))
    taken, left, attempt, out = None, found, 0, None
    while True:
        drawn = tables.save(draw(left, attempt), f"drawn{attempt}")
        first = drawn.groupBy(F.split("type", "-")[0].alias("t"), "surrogate").agg(F.min(F.struct("type", "value")).alias("w"))
        first = first.join(real.withColumn("t", F.split("t", "-")[0]).distinct(), ["t", "surrogate"], "left_anti")
        if taken is not None:
            first = first.join(taken, ["t", "surrogate"], "left_anti")
        kept = tables.save(first.select("t", "surrogate", F.col("w.type").alias("type"), F.col("w.value").alias("value")), f"kept{attempt}")
        if attempt:
            out = kept if out is None else out.union(kept)
        left = tables.save(left.select("type", "value").join(kept, ["type", "value"], "left_anti"), f"left{attempt}")
        taken = kept.select("t", "surrogate") if taken is None else taken.union(kept.select("t", "surrogate"))
        if not left.head(1):
            break
        attempt += 1
    out = kept.where("false") if out is None else out
    return out.select("type", "value", "surrogate")


def replace_pii(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """docs with the text's entities replaced by surrogates, and pii_types, the type of each replacement in order.

    Equal entities get equal surrogates in all documents, different ones of a type different ones, and no surrogate is an
    entity of the documents. Texts without entities, null and empty ones stay as they are. Rows are kept as they are,
    repeated ones too. A column pii_types of docs is replaced. The key must be kept secret.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "pii")
    secret = key.encode()
    text = F.col(text_col)
    some = F.coalesce(text.rlike(QUICK), F.lit(False))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = sorted({(k, v) for t in b.column(0).to_pylist() for _, _, k, v in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([v for _, v in own], pa.string())], ["type", "value"])

    found = docs.where(some).select(text.cast("string").alias("text")).mapInArrow(detect, "type string, value string")
    found = tables.save(found.distinct(), "entities")
    others = override_table(found, secret, tables)
    n = others.count()
    known = {(r.type, r.value): r.surrogate for r in others.collect()} if n <= broadcast_rows else None
    shared = spark.sparkContext.broadcast(known)

    def rewrite(t: str | None, own: dict) -> tuple[str | None, list[str]]:
        if t is None:
            return None, []
        out, at, kinds = [], 0, []
        for a, b, k, v in entities(t):
            new = own.get((k, v)) or surrogate(secret, k, v)
            out += [t[at:a], dress(t[a:b], k, new)]
            kinds.append(k.split("-")[0])
            at = b
        return "".join([*out, t[at:]]), kinds

    def replaced(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        all_ = shared.value or {}
        for column, maps in batches:
            texts, kinds = [], []
            for t, own in zip(column.to_pylist(), maps.to_pylist()):
                mine = all_ if own is None else {**all_, **{(x["type"], x["value"]): x["surrogate"] for x in own}}
                new, k = rewrite(t, mine)
                texts.append(new)
                kinds.append(k)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["text", "kinds"])

    kind = "array<struct<type:string,value:string,surrogate:string>>"
    apply = F.arrow_udf(replaced, "text string, kinds array<string>")
    docs = docs.drop("pii_types")
    plain = docs.where(~some).withColumn("pii_types", F.array().cast("array<string>"))
    rich = docs.where(some)
    if known is not None:
        rich = rich.withColumn("_own", F.lit(None).cast(kind))
    else:

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = sorted({(h, k, v) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for _, _, k, v in entities(t)})
                columns = zip(*rows) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["_hash", "type", "value"])

        rich = rich.withColumn("_hash", F.sha2(text, 256))
        said = rich.select("_hash", text.cast("string")).mapInArrow(mentions, "_hash string, type string, value string").distinct()
        own = said.join(others, ["type", "value"]).groupBy("_hash").agg(F.collect_list(F.struct("type", "value", "surrogate")).alias("_own"))
        rich = rich.join(own, "_hash", "left").drop("_hash")
    rich = rich.withColumn("_new", apply(text.cast("string"), F.col("_own")))
    rich = rich.withColumns({text_col: F.col("_new.text"), "pii_types": F.col("_new.kinds")}).drop("_own", "_new")
    return plain.unionByName(rich)
