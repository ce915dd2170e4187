"""Personal data: detected entities get keyed surrogates of the same type and form.

* Coreference: a surrogate depends on the key, the type and the entity's canonical
  form (case and separators removed), so every mention in every document gets the same
  one, written as the mention is (case, separators). A name is what follows a title: up
  to three capitalised words, with initials and particles (van, de la) among them; parts
  that a hyphen or an apostrophe joins are names each. A family name found with a title
  is replaced wherever it stands in the same document. A phone number is one, whether its
  country code follows + or 00 and whether (0) is written.
* Form: digits stay digits, letters stay letters of their script and case; card numbers
  (those with a right check digit) keep it right, addresses stay valid, account numbers get
  right check digits; names keep gender (by title) and script.
* Distinctness: surrogates of all documents are compared. If two entities of a type
  share one, or one equals an entity that occurs, the later entity by canonical form
  draws again, until none collides. Only those exceptions are joined to documents.

Defined results: a null text stays null, an empty one empty; repeated rows are each
returned, and rows that share an id or have none get the same surrogates as any other;
where two patterns match one place, the first listed wins, and of two entities that
draw the same surrogate the first by form keeps it. Very long texts are read whole.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.shared import slices, written

#: Titles before a name, by gender.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Г-н"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Signora", "Госпожа", "Г-жа"],
    "n": ["Dr", "Prof", "Professor", "Доктор"],
}
GENDER = {title: gender for gender, titles in TITLES.items() for title in titles}
#: Syllables and endings of made-up names, by script; endings by gender.
SYLLABLES = {
    "latin": ["ba", "be", "bri", "ca", "co", "da", "de", "do", "fa", "fe", "ga", "gri", "ha", "he", "ja", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "ta", "te", "to", "va", "ve", "wi"],
    "cyrillic": ["ба", "ва", "ве", "га", "да", "де", "жа", "за", "ка", "ко", "ла", "ле", "ли", "ма", "ми", "на", "не", "па", "ра", "ро", "са", "се", "та", "то"],
    "greek": ["βα", "γε", "δα", "δη", "θε", "κα", "κο", "λα", "λε", "μα", "μη", "να", "νι", "πα", "πε", "ρα", "ρο", "σα", "σε", "τα"],
}
ENDINGS = {
    "latin": {"m": ["n", "rd", "k"], "f": ["na", "lia", "ssa"], "n": ["l", "s", "r"]},
    "cyrillic": {"m": ["н", "р", "м"], "f": ["на", "ля", "ра"], "n": ["й", "л", "т"]},
    "greek": {"m": ["ς"], "f": ["να"], "n": ["ν"]},
}

#: Words within a name that are no name, in the languages that have them.
PARTICLES = frozenset("von van der den de del della di da do dos du la le lo zu zum zur ter ten bin ibn al el af av".split())
#: A word of a name, with what hyphens and apostrophes join; a genitive's s is not its own.
_WORD = r"[^\W\d_]+(?:[-'’](?!s\b)[^\W\d_]+)*"
#: A digit of a phone number, with what may stand before it.
_NEXT = r"(?:(?:[ ./-]|[ .-]?\(|\)[ .-]?)?\d)"
PATTERNS = {
    "token": re.compile(r"(?<![\w-])(?:(?:sk|pk|rk)[-_](?:[a-z]{3,8}[-_])?|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|npm_|hf_|eyJ)(?=[\w.-]*\d)[A-Za-z0-9_-]{16,}(?:\.[A-Za-z0-9_-]{8,}){0,2}(?![\w-])"),
    "email": re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+", re.UNICODE),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "secret": re.compile(r"\b(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,128}\b"),
    "card": re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w.+-])(?:"
        # A country code: as many digits as numbers of en, fr, de and es have, else 7 to 15 in all.
        rf"(?:\+|00(?=\d{{1,3}}[ ./-]))(?:1{_NEXT}{{10}}|33{_NEXT}{{9,10}}|34{_NEXT}{{9}}|4[49]{_NEXT}{{6,11}}|[1-9]{_NEXT}{{6,14}})"
        # A leading 0 and no date: pairs, an area code and groups, or the ten or eleven digits of a mobile.
        r"|(?!0[1-9]([ .-])(?:0[1-9]|1[0-2])\1(?:19|20)\d\d(?!\d))"
        r"(?:0[1-9](?:[ .-]?\d{2}){4}|(?=(?:[ ()./-]{0,3}\d){7,15}(?![ .-]?\d))(?:\(0[1-9]\d{0,4}\) ?|0[1-9]\d{1,4}[ ./-]|0[1-9][ ./-](?=\d{3}))\d{2,8}(?:[ .-]\d{2,8}){0,4}|0[1-9]\d{8,9})"
        # North American, with all parts marked, and Spanish.
        r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\2\d{4}|[2-9]\d{2} \d{3} \d{4}|[6-9]\d{2}([ .-])\d{2}\3\d{2}\3\d{2}"
        r")(?![\w-]|\.\d)"
    ),
}
TITLE = re.compile(r"\b(" + "|".join(sorted(GENDER, key=len, reverse=True)) + r")\.?(?=[ \t])")
#: What follows a title: an initial, or a word.
STEP = re.compile(rf"[ \t]+(?:([^\W\d_])\.(?=[ \t-])|({_WORD})(?!\w))")
#: A whole word, or a part of one that a hyphen or an apostrophe joins.
PART = re.compile(r"(?<!\w)[^\W\d_]{2,}(?!\w)")
#: Name words after a title, at most.
NAME_WORDS = 3
#: The part of an access token that says whose it is; it stays.
TOKEN_HEAD = re.compile(r"(?:sk|pk|rk)[-_](?:[a-z]{3,8}[-_])?|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|npm_|hf_|eyJ")
#: What every pattern but that of e-mail needs.
DIGITS = re.compile(r"\d")
#: Country codes of one and two digits; the others have three.
COUNTRY = re.compile(r"(?:\+|00)(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")

Mention = tuple[int, int, str, str]


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def canonical(kind: str, text: str) -> str:
    if kind == "phone" and text.startswith(("+", "00")):  # one number, however its country code is written
        return "+" + re.sub(r"\D", "", text.replace("(0)", "")).removeprefix("00")
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "token":
        return text
    return text.casefold() if kind.startswith(("given", "family")) else text.lower()


def find(text: str) -> list[Mention]:
    """Mentions in order, without overlaps: start, end, type, canonical form. The first type in the list of patterns wins."""
    taken: list[Mention] = []  # by start; without overlaps, so only the two neighbours can meet a new one

    def add(start: int, end: int, kind: str) -> None:
        at = bisect(taken, start, key=lambda m: m[0])
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end, kind, canonical(kind, text[start:end])))

    has_digits = DIGITS.search(text) is not None
    for kind, pattern in PATTERNS.items():
        if (kind == "email" and "@" in text) or (kind != "email" and has_digits):
            for m in pattern.finditer(text):
                if kind == "card" and _luhn(re.sub(r"\D", "", m.group())):
                    continue  # a number, not a card's
                add(m.start(), m.end(), kind)
    families: set[str] = set()
    m = TITLE.search(text)
    while m:
        words, end = _name_after(text, m.end())
        for k, (start, stop) in enumerate(words):
            kind = "family:n" if k == len(words) - 1 else f"given:{GENDER[m.group(1)]}"
            parts = [(start, stop)] if stop - start == 1 else [p.span() for p in PART.finditer(text, start, stop)]
            for a, b in parts:
                add(a, b, kind)
                if kind == "family:n":
                    families.add(text[a:b])
        m = TITLE.search(text, end)
    if families:
        for w in PART.finditer(text):
            if w.group() in families:
                add(*w.span(), "family:n")
    return taken


def _name_after(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Places of the initials and words of a name that begins there, the family's last, and where it ends. Particles within it are passed over."""
    held: list[tuple[int, int]] = []
    kept, names, end = 0, 0, at
    while names < NAME_WORDS and (step := STEP.match(text, at)):
        at = step.end()
        if step.group(1):
            if not step.group(1).isupper():
                break
            held.append(step.span(1))
            continue
        word = step.group(2)
        if word in PARTICLES:
            continue
        letters = word.partition("-")[0]
        if not (word[0].isupper() or re.match(r"[^\W\d_]['’][^\W\d_]", word) and word[2].isupper()) or letters in GENDER or len(word) < 2:
            break
        held.append(step.span(2))
        kept, names, end = len(held), names + 1, at
    return held[:kept], end


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self.key, self.parts, self.block, self.left = key, "\0".join(parts), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, f"{self.parts}\0{self.block}".encode(), hashlib.sha256).digest()
            self.block += 1
        number, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return number % n


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin" if c < "ɐ" else ""


@cache
def _letters_like(c: str) -> str:
    """Letters of the same alphabet, case and kind near ``c``, without marks, signs and unassigned places."""
    alphabet = lambda x: (unicodedata.category(x), unicodedata.name(x, "").partition(" ")[0])
    start = ord(c) // 256 * 256
    return "".join(x for x in map(chr, range(start, start + 256)) if alphabet(x) == alphabet(c)) or c


def surrogate(key: bytes, kind: str, form: str, draw: int = 0) -> str:
    """The canonical form of the entity's surrogate; another for each ``draw``."""
    random = _Stream(key, kind, form, str(draw))
    digit = lambda: str(random.below(10))
    if kind.startswith(("given", "family")):
        script, gender = _script(form), kind[-1]
        if not script:  # letters of the same alphabet
            return "".join(near[random.below(len(near))] if unicodedata.category(c)[0] == "L" and (near := _letters_like(c)) else c for c in form)
        made = "".join(SYLLABLES[script][random.below(len(SYLLABLES[script]))] for _ in range(2 + random.below(2) + draw // 8))
        return made + ENDINGS[script][gender][random.below(len(ENDINGS[script][gender]))]
    if kind == "ip":
        return ".".join(str(1 + random.below(254)) for _ in range(4))
    if kind == "card":
        body = "".join(digit() for _ in form[:-1])
        right = next(c for c in "0123456789" if _luhn(body + c) == 0)
        return body + right
    if kind == "phone":  # the country code stays, else the first digit; the 0 before an area code, too
        coded = COUNTRY.match(form)
        head = coded.group() if coded else form[0]
        head += "0" * bool(coded and form[len(head)] == "0")
        return head + str(1 + random.below(9)) + "".join(digit() for _ in form[len(head) + 1 :])
    if kind == "iban":
        body = "".join(digit() if c.isdigit() else chr(65 + random.below(26)) for c in form[4:])
        value = int("".join(str(int(c, 36)) for c in body + form[:2]) + "00")
        return f"{form[:2]}{98 - value % 97:02d}{body}"
    if kind == "token":
        head = TOKEN_HEAD.match(form).group()
        kinds = {"N": "0123456789", "Lu": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "Ll": "abcdefghijklmnopqrstuvwxyz"}
        like = lambda c: kinds["N" if c.isdigit() else "Lu" if c.isupper() else "Ll"]
        return head + "".join(like(c)[random.below(len(like(c)))] if c.isalnum() else c for c in form[len(head) :])
    if kind == "secret":
        return "".join("0123456789abcdef"[random.below(16)] for _ in form)
    local, at, domain = form.partition("@")
    change = lambda s: "".join(digit() if c.isdigit() else chr(97 + random.below(26)) if "a" <= c <= "z" else _letters_like(c)[random.below(len(_letters_like(c)))] if c.isalpha() else c for c in s)
    name, dot, top = domain.rpartition(".")
    return change(local) + at + change(name) + dot + top


def render(mention: str, form: str) -> str:
    """A surrogate written as the mention is: its separators, its case."""
    if TOKEN_HEAD.match(mention) and form.startswith(TOKEN_HEAD.match(mention).group()):
        return form
    if len(mention) == 1:
        return form[:1].upper()
    if "@" in mention and len(form) == len(mention):
        return "".join(f.upper() if m.isupper() else f for f, m in zip(form, mention, strict=True))
    if re.fullmatch(r"\+?[\d ()./-]+", mention) and "." not in form:
        shown, doubled = form.lstrip("+"), form[:1] == "+" and mention.startswith("00")
        if form[:1] == "+" and "(0)" in mention:  # the mention has a 0 that the number has not
            k = len(re.sub(r"\D", "", mention.partition("(0)")[0])) - 2 * doubled
            shown = f"{shown[:k]}0{shown[k:]}"
        digits = iter("00" + shown if doubled else shown)
        return "".join(next(digits, "") if c.isdigit() else c for c in mention)
    if mention.isupper() and " " in mention and form.replace(" ", "").isalnum():
        letters = iter(form)
        return "".join(c if c == " " else next(letters, "") for c in mention)
    if mention.isupper():
        return form.upper()
    if mention[:1].isupper() and mention[1:].islower() and "@" not in mention:
        return form[:1].upper() + form[1:]
    return form


def replaced(text: str, key: bytes, draws: dict[tuple[str, str], int]) -> tuple[str, int]:
    out, at, found = [], 0, find(text)
    for start, end, kind, form in found:
        out += (text[at:start], render(text[start:end], surrogate(key, kind, form, draws.get((kind, form), 0))))
        at = end
    out.append(text[at:])
    return "".join(out), len(found)


def _place(doc_id: Column, text: Column) -> Column:
    """Where a mention stands: the document's id, or its text's hash where it has none."""
    return F.coalesce(F.concat(F.lit("id "), doc_id.cast("string")), F.concat(F.lit("text "), F.xxhash64(text)))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kind, form: the different entities of each document."""
    rows = docs.select(_place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(i, kind, form) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for kind, form in dict.fromkeys(m[2:] for m in find(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(3)], names=["id", "kind", "form"])

    return rows.mapInArrow(run, "id string, kind string, form string")


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """Adds the surrogate of each entity (kind, form, draw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kinds, forms, draws = (batch.column(k).to_pylist() for k in range(3))
            made = [surrogate(key, k, f, d) for k, f, d in zip(kinds, forms, draws, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], names=["kind", "form", "draw", "made"])

    return entities.select("kind", "form", "draw").mapInArrow(run, "kind string, form string, draw int, made string")


def settle(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, form, draw, made with no two surrogates of a kind alike, and none like an entity that occurs.

    Names are compared across genders. Each round only those that collide draw again;
    a round's rest is a small share of the round before.
    """
    group = F.regexp_replace("kind", ":.*", "").alias("group")
    real = written(entities.select("kind", "form").distinct(), "entities")
    settled = written(_drawn(real.withColumn("draw", F.lit(0)), key), "surrogates")
    while True:
        grouped = settled.withColumn("group", group)
        # Those that have kept theirs so far come first, then the least form.
        first = grouped.groupBy("group", "made").agg(F.min(F.struct("draw", "kind", "form")).alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = grouped.join(first, ["group", "made"]).where("struct(draw, kind, form) <> first").select("kind", "form")
        taken = grouped.join(real.select(group, F.col("form").alias("made")).distinct(), ["group", "made"], "left_semi").select("kind", "form")
        again = written(twice.union(taken).distinct(), "collisions")
        if again.isEmpty():
            return settled
        redrawn = _drawn(settled.join(again, ["kind", "form"], "left_semi").withColumn("draw", F.col("draw") + 1), key)
        settled = written(settled.join(again, ["kind", "form"], "left_anti").unionByName(redrawn), "surrogates")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text with surrogates, n_entities (mentions replaced)."""
    secret = key.encode()
    found = written(mentions(docs, id_col, text_col), "mentions")
    exceptions = settle(found, secret).where("draw > 0").select("kind", "form", "draw")
    # One row a document that mentions an exception; bounded by its text.
    of_docs = found.join(exceptions, ["kind", "form"]).distinct().groupBy("id").agg(F.collect_list(F.struct("kind", "form", "draw")).alias("draws")).withColumnRenamed("id", "__id")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.join(of_docs, _place(F.col("id"), F.col("text")) == F.col("__id"), "left").select("id", "text", "draws")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, n = [], []
            for text, draws in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new, count = (None, 0) if text is None else replaced(text, secret, {(d["kind"], d["form"]): d["draw"] for d in draws or []})
                out.append(new)
                n.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64())], names=["id", "text", "n_entities"])

    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_entities long")
    return made.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities")
