"""Personal information inside free text (problem 5).

Method: offset-preserving deobfuscation. A transducer rewrites a text into a plain form in passes
(entities, markup, homoglyphs, compatibility and zero-width characters; spelled digits, also doubled
and tripled; at/dot disguises) and remembers for every character which source characters it came from. Identifiers are detected in the
plain form, and their spans are mapped back, so the placeholders stand in the source and the rest of
it is untouched. Names need a lexicon; it is counted from the names people give themselves.
"""

from __future__ import annotations

import functools
import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

KINDS = ("email", "id_number", "phone", "street_address", "person_name")
#: Entries of each half of the name lexicon, most frequent first; the bound on what is broadcast.
#: Names beyond it are looked up by a join.
LEXICON = 100_000

# Words and characters by which disguises and identifiers are recognised.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІοαΟΑΒΕΖΗΙΚΜΝΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTXIoaOABEZHIKMNPTYX"))
STREETS = "street|str|st|row|lane|ln|close|court|ct|hill|road|rd|avenue|ave|boulevard|blvd|terrace|drive|place|square|crescent|gardens|mews|grove|parkway|highway|alley|walk"
MORE_STREETS = "Parade|Quay|Wharf|Circus|Rise|Vale|Heights|Embankment|Esplanade|Promenade|Causeway|Trail|Way|Green|Gate|Park|Wynd|Croft|Villas|Turnpike"
STREET_ENDS = "straße|strasse|str\\.|gasse|weg|platz|allee|ufer|damm|ring"
STREET_HEADS = "calle|via|viale|rua|rue|avenida|av\\.|plaza|piazza|corso|ulica|ul\\.|carrer|paseo|chemin|impasse|travessa"
ID_LABELS = (
    r"passport|passeport|pasaporte|passaporto|reisepass|personalausweis\w*|ausweis\w*|identity card|id card|national id(?:entity)?|citizen (?:number|id)|social security|social insurance|sozialversicherung\w*"
    r"|my social|ssn|sin|ni number|nino|national insurance|tin|itin|tax (?:id|number|no)|steuer-?id\w*|steuernummer|nif|dni|nie|cpf|codice fiscale|driver'?s? licen[cs]e|driving licen[cs]e|führerschein\w*|permis de conduire|pesel|bsn|ahv|insee"
)
PHONE_LABELS = r"☎|📞|📱|tel|telephone|phone|fax|mobile|mob|cell|handy|whatsapp|call|ring|text me on|call or text|office|number is|dial|sms"
TITLES = r"dr|prof|mr|mrs|ms|mx|herr|frau|señora?|sr|sra|mme|monsieur"
INTRODUCTIONS = r"my name is|name's|ich heiße|ich heisse|je m'appelle|me llamo|mi nombre es|mi chiamo|meu nome é|regards,|signed,|c/o"
NOT_PEOPLE = "theorem|test|lemma|method|distribution|transform|algorithm|index|law|inequality|systems|ltd|inc|llc|gmbh|corp|labs|analytics|software|institute|award|prize|university|street|lane|road"

_ZERO = "­​‌‍‎‏⁠﻿"
_DIGIT = "|".join(DIGIT_WORDS)
_CHARS = regex.compile(rf"(?P<tag><(?!\s*(?:at|dot|@|\.)\s*>)[^<>]+>)|(?P<entity>&(?:#\d+|#x[0-9a-f]+|[a-z]+\d?);)|(?P<zero>[{_ZERO}])|(?P<other>[^\x00-\x7f])", regex.I)
_NEEDS_CHARS = regex.compile(r"[<&]|[^\x00-\x7f]")
_KEPT = regex.compile(r"(?:mailto|tel):[^\"'>\s?]+", regex.I)
# A spelled digit, also doubled or tripled, or figures between spelled ones.
_ITEM = rf"(?:(?:(?P<times>double|triple)[\s-]+)?(?P<word>{_DIGIT})\b|(?P<figures>\d{{1,4}})\b)"
_SPELLED = regex.compile(rf"\b(?:(?:(?:double|triple)[\s-]+)?(?:{_DIGIT})|\d{{1,4}})(?:[\s,.-]{{1,3}}(?:(?:(?:double|triple)[\s-]+)?(?:{_DIGIT})|\d{{1,4}}))+\b", regex.I)
_ITEMS = regex.compile(_ITEM, regex.I)
_NEEDS_SPELLED = regex.compile(rf"\b(?:{_DIGIT})\W{{1,3}}(?:{_DIGIT}|\d+|double|triple)\b", regex.I)
_BRACKETED = r"\s*[\(\[\{{<]\s*(?:{0})\s*[\)\]\}}>]\s*"
_AT = r"(?:\s?@\s?|" + _BRACKETED.format("at|@") + r"|\s+at\s+)"
_DOT = r"(?:\.|" + _BRACKETED.format(r"dot|\.") + r"|\s+dot\s+)"
# Words that no mailbox's host begins with.
_NO_HOST = r"(?!(?:the|an?|this|that|my|our|your|his|her|their|dot)\b)"
_PART = r"[\p{L}\d](?:[\p{L}\d_+%'-]{0,62}[\p{L}\d])?"
# Words before "at" that name no mailbox.
_AT_PLACE = r"works?|working|worked|looks?|looking|lives?|living|hosted|employed|stud(?:y|ying|ied)|based"
#: A mail address whose at or dots may be spelled, of at most ten parts on either side; it ends where no further at follows.
_CHAIN = regex.compile(rf"(?<![\w@.])(?P<local>{_PART}(?:{_DOT}{_PART}){{0,8}}+)(?P<at>{_AT}){_NO_HOST}{_PART}(?:{_DOT}{_PART}){{0,8}}{_DOT}\p{{L}}{{2,}}(?![\w@])(?!{_BRACKETED.format('at|@')}|\s+at\s+{_PART}(?:\.|\s+dot\s))", regex.I)
_NEEDS_CHAIN = regex.compile(r"\sdot\s|[\(\[\{<]\s*(?:dot|\.|at|@)\s*[\)\]\}>]|(?<=\w\s)(?-i:AT)(?=\s\w)", regex.I)
_SEPARATOR = regex.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", regex.I)
_DISGUISED = regex.compile(rf"{_BRACKETED.format(r'at|@|dot|\.')}|\s+dot\s+", regex.I)


class _Tape:
    """What a pass of the transducer writes: characters, each with the start and end of its source."""

    def __init__(self, text: str, start: list[int] | None, end: list[int] | None):
        self.text, self.from_start, self.from_end = text, start, end
        self.out: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []

    def keep(self, a: int, b: int) -> None:
        """The characters from a to b as they are."""
        self.out.append(self.text[a:b])
        self.start += self.from_start[a:b] if self.from_start else range(a, b)
        self.end += self.from_end[a:b] if self.from_end else range(a + 1, b + 1)

    def put(self, s: str, a: int, b: int) -> None:
        """s in place of what stands from a to b."""
        self.out.append(s)
        self.start += [self.from_start[a] if self.from_start else a] * len(s)
        self.end += [self.from_end[b - 1] if self.from_end else b] * len(s)

    def read(self) -> tuple[str, list[int], list[int]]:
        return "".join(self.out), self.start, self.end


def _characters(text: str) -> tuple[str, list[int], list[int]]:
    """First pass: markup, entities, zero-width and compatibility characters, homoglyphs."""
    tape, at = _Tape(text, None, None), 0
    for m in _CHARS.finditer(text):
        tape.keep(at, m.start())
        a, at = m.span()
        kind, s = m.lastgroup, m[0]
        if kind == "tag":
            # A tag separates, but an address inside it is kept where it stands.
            kept = _KEPT.search(s)
            tape.put("\n", a, a + 1)
            if kept:
                tape.keep(a + kept.start(), a + kept.end())
                tape.put("\n", at - 1, at)
        elif kind == "entity":
            tape.put(html.unescape(s).replace("\xa0", " "), a, at)
        elif kind == "other":
            latin = s in HOMOGLYPHS and ((a and text[a - 1].isascii() and text[a - 1].isalpha()) or (at < len(text) and text[at].isascii() and text[at].isalpha()))
            tape.put(HOMOGLYPHS[s] if latin else s if s.isalpha() and unicodedata.name(s, "").startswith("LATIN SMALL LETTER SHARP") else unicodedata.normalize("NFKC", s), a, at)
    tape.keep(at, len(text))
    return tape.read()


def _spelled(tape: _Tape, m: regex.Match) -> bool:
    """Writes a run of spelled digits as digits, each from its word; runs of fewer than four or mostly of figures stay."""
    items = list(_ITEMS.finditer(m[0]))
    words = sum(i["word"] is not None for i in items)
    if words < 3 or len(items) < 4:
        return False
    for i in items:
        a, b = m.start() + i.start(), m.start() + i.end()
        if i["word"]:
            tape.put(DIGIT_WORDS[i["word"].lower()] * {"double": 2, "triple": 3}.get((i["times"] or "").lower(), 1), a, b)
        else:
            tape.keep(a, b)
    return True


def _address(tape: _Tape, m: regex.Match) -> bool:
    """Writes a disguised mail address with its at and dots; what merely has "at" between words stays."""
    bare = m["at"].isspace() is False and m["at"].strip().lower() == "at"
    if not _DISGUISED.search(m[0]) and not (bare and m["at"].strip() == "AT" and not m["local"].isupper()):
        return False
    if bare and regex.fullmatch(_AT_PLACE, m["local"], regex.I):
        return False
    at = m.start()
    for x in _SEPARATOR.finditer(tape.text, m.start(), m.end()):
        tape.keep(at, x.start())
        tape.put("@" if x["at"] else ".", x.start(), x.end())
        at = x.end()
    tape.keep(at, m.end())
    return True


def plain(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The plain form, and for each of its characters the start and end of its source; None where nothing changed.

    Characters are rewritten first, then spelled digits, then the disguises of at and dot, each pass
    on what the one before it wrote.
    """
    out: tuple[str, list[int] | None, list[int] | None] = (text, None, None)
    if _NEEDS_CHARS.search(text):
        out = _characters(text)
    for needs, pattern, write in ((_NEEDS_SPELLED, _SPELLED, _spelled), (_NEEDS_CHAIN, _CHAIN, _address)):
        if needs.search(out[0]):
            tape, at = _Tape(*out), 0
            for m in pattern.finditer(out[0]):
                tape.keep(at, m.start())
                at = m.end()
                if not write(tape, m):
                    tape.keep(m.start(), at)
            tape.keep(at, len(out[0]))
            out = tape.read()
    return out


_LOCAL, _LABEL = r"(?<![\w.+%'-])[\w](?:[\w.+%'-]{0,62}[\w])?", r"[\p{L}\d](?:[\p{L}\d-]{0,62}[\p{L}\d])?"
_EMAIL = regex.compile(rf"(?:mailto:)?{_LOCAL}\s?@\s?{_LABEL}(?:\.{_LABEL})*\.\p{{L}}{{2,}}(?![\w])", regex.I)
_ID = [
    regex.compile(rf"(?<!\w)(?:{ID_LABELS})\b[\s:#.]*(?:(?:no|nr|number|num|nummer|is|n[°ºo])\b[\s:#.]*){{0,2}}(?P<v>(?=(?:[\p{{L}}0-9./ -]{{0,12}}\d){{4}})[\p{{L}}0-9]+(?:[./ -]?(?=[A-Z]?\d|[A-Z]\b)[A-Z0-9]+)*)", regex.I),
    regex.compile(r"(?<![\w.-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])"),
    regex.compile(r"(?<![\w.-])(?P<v>[A-CEGHJ-PR-TW-Z][A-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?!\w)"),
    regex.compile(r"(?<![\w.-])(?P<v>\d{3}\.\d{3}\.\d{3}-\d{2})(?![\w-])"),
]
_BEFORE, _AFTER = r"(?<![\w/.,#+-])", r"(?!\d|[-/.,]\d|\w)"
_EXT = r"(?:\s?(?:x|ext\.?)\s?\d{1,5})?"
_PHONE = [
    regex.compile(rf"(?<![\w+])(?:tel:)?\+\d(?:[\s().-]{{0,2}}\d){{6,14}}{_EXT}(?!\d)"),
    regex.compile(rf"{_BEFORE}00[1-9]\d{{0,2}}[-. ]\(?\d{{1,5}}\)?(?:[-. ]\d{{2,}})+{_AFTER}"),
    regex.compile(rf"(?<![\w/.-])\((?:\d{{3}}|0\d{{2,5}})\)\s?\d{{3,4}}[-. ]?\d{{3,4}}{_EXT}{_AFTER}"),
    regex.compile(rf"{_BEFORE}(?:1[-. ])?\d{{3}}([-. ])\d{{3}}\1\d{{4}}{_EXT}{_AFTER}"),
    regex.compile(rf"{_BEFORE}0\d{{2,4}}/\d{{3,8}}(?:-\d{{1,5}})?{_AFTER}"),
    regex.compile(rf"{_BEFORE}0(?:\d{{4}}[ -]\d{{6}}|\d{{3}}[ -]\d{{3}}[ -]\d{{4}}|\d{{2}}[ -]\d{{4}}[ -]\d{{4}}|(?: \d{{2,3}}){{4}}){_AFTER}"),
    regex.compile(rf"(?<!\w)(?:{PHONE_LABELS})[.:,]?\s*(?:no\.?|number|is|at|on|:)?\s*(?P<v>\(?\d(?:[\s().-]?\d){{6,14}}){_AFTER}", regex.I),
]
_ANY_DIGIT, _RUN = regex.compile(r"\d"), regex.compile(r"(?<!\d)\d{7,15}(?!\d)")
_LOCAL_PHONE = regex.compile(rf"{_BEFORE}\d{{3}}-\d{{4}}{_AFTER}")
_COUNTED = regex.compile(r"(?<!\w)(?:ticket|order|build|version|row|issue|invoice|page|isbn|bug|case|room|id|no\.?|#|record|score|points?)[ \t:#]*\Z", regex.I)
_NAME = r"\p{Lu}[\p{L}'’-]{1,60}"
# Words of titles and counts, not of street names.
_NO_STREET = r"(?!(?:Minutes?|Hours?|Days?|Weeks?|Months?|Years?|Seconds?|Miles?|Ways?|Steps?|Things?|Tips?|Down|Up|Of|The|In|On|To|And|For|With|From|Into|Across|Along)\b)"
#: A street of up to three capitalised words before what kind of street it is.
_CAPITALISED = regex.compile(rf"(?<![\w.,/-])\d{{1,5}}[A-Za-z]?(?:-\d{{1,5}}[A-Za-z]?)?,?\s+(?:[NSEW]\.?\s+)?(?:{_NO_STREET}\p{{Lu}}[\p{{L}}'’-]{{1,60}}\s+){{1,3}}(?:{'|'.join(w.capitalize() for w in STREETS.split('|'))}|{MORE_STREETS})\b(?:(?<=\b(?:St|Rd|Ave|Blvd|Ln|Ct|Str))\.)?(?!\s+\p{{Lu}}[\p{{L}}]+\s+(?:rules?|club)\b)")
_ADDRESS = [
    regex.compile(rf"(?<![\w.,/-])\d{{1,5}}\s?[A-Za-z]?(?:-\d{{1,5}}[A-Za-z]?)?,?\s+(?:[NSEW]\.?\s+)?[\p{{L}}'’-]{{2,60}}\s+(?:{STREETS})\b\.?(?!\s+\p{{Lu}}[\p{{L}}]+\s+(?:rules?|club)\b)", regex.I),
    regex.compile(rf"(?<!\w){_NAME}\s+(?:{STREETS})\.?,?\s+(?:no\.?\s*)?\d{{1,5}}[A-Za-z]?\b(?!\s+\p{{Ll}}+s\b)", regex.I),
    regex.compile(rf"(?<![\w-])[\p{{L}}-]{{2,60}}(?:{STREET_ENDS})\s+\d{{1,4}}\s?[a-z]?(?:/\d{{1,4}})*(?!\w)", regex.I),
    regex.compile(rf"(?<!\w)(?:{STREET_HEADS})\s+(?:d[aeiou]s?\s+|del\s+|de la\s+|d')?[\p{{L}}'’-]{{2,}},?\s+(?:n[º°o]?\.?\s*)?\d{{1,5}}(?:/\d{{1,4}})*", regex.I),
    regex.compile(r"(?<![\w.,/-])\d{1,5}[A-Za-z]?,?\s+(?:bis,?\s+)?(?:rue|avenue|boulevard|place|chemin|impasse|quai)\s+(?:du|des|de la|de l'|de|d')\s*[\p{L}'’-]{2,}", regex.I),
]
_TOKEN = regex.compile(r"\p{L}[\p{L}'’-]*\.?")
_NOT_PEOPLE = regex.compile(rf"[\s-]+(?:{NOT_PEOPLE})\b", regex.I)
_OWN = r"^\s*(\p{Lu}[\p{L}'’-]+)(?:\s+\p{Lu}\.)?\s+(\p{Lu}[\p{L}'’-]+)\s*$"
_DISPLAYED = regex.compile(_OWN)
_FULL = rf"(?:{_NAME}|\p{{Lu}}\.)(?:\s+\p{{Lu}}\.)?\s+{_NAME}"
_TITLED = regex.compile(rf"(?<!\w)(?i:{TITLES})\b\.?\s+(?P<v>(?:(?:\p{{Lu}}\.\s*)+|{_NAME}\s+){_NAME})")
_INTRODUCED = regex.compile(rf"(?<!\w)(?i:{INTRODUCTIONS})\s+(?P<v>{_FULL}|{_NAME},\s{_NAME})(?!\w)")


@functools.lru_cache(1 << 16)
def fold(word: str) -> str:
    """Lower case without marks, for looking names up."""
    word = word.lower()
    if word.isascii():
        return word
    word = unicodedata.normalize("NFD", word.replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("ß", "ss").replace("æ", "ae"))
    return "".join(c for c in word if not unicodedata.combining(c))


def _kind(token: str, *known: set[str]) -> str:
    """What a word can be in a name: i an initial, g a given name, f a family name; known are given and family names, twice."""
    bare = fold(token.rstrip("."))
    if len(bare) == 1:
        return "i" if token.endswith(".") else ""
    if "-" in bare:
        # Of a double name one half tells.
        halves = {bare, *bare.split("-")}
        return "".join(k for k, one, two in (("g", known[0], known[2]), ("f", known[1], known[3])) if not (halves.isdisjoint(one) and halves.isdisjoint(two)))
    return ("g" if bare in known[0] or bare in known[2] else "") + ("f" if bare in known[1] or bare in known[3] else "")


def _names(text: str, given: set[str], family: set[str], more: tuple[set[str], set[str]]) -> Iterator[tuple[int, int]]:
    for p in (_TITLED, _INTRODUCED):
        for m in p.finditer(text):
            if not _NOT_PEOPLE.match(text, m.end()):
                yield m.span("v")
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    kinds = [_kind(t, given, family, *more) for _, _, t in tokens]
    for n in range(len(tokens) - 1):
        if not kinds[n]:
            continue
        for reach in (1, 2):
            if n + reach >= len(tokens) or (reach == 2 and "i" not in kinds[n + 1]):
                continue
            between = text[tokens[n][1] : tokens[n + 1][0]]
            if reach == 2 and text[tokens[n + 1][1] : tokens[n + 2][0]] != " ":
                continue
            last = kinds[n + reach]
            ahead = between == " " and ("g" in kinds[n] or "i" in kinds[n]) and "f" in last
            turned = reach == 1 and between == ", " and "f" in kinds[n] and ("g" in last or last == "i")
            # A family name ends where a point ends it, unless the point ends an initial.
            if (ahead and not tokens[n][2].endswith(".") or ahead and "i" in kinds[n] or turned) and not _NOT_PEOPLE.match(text, tokens[n + reach][1]):
                yield tokens[n][0], tokens[n + reach][1] - (tokens[n + reach][2].endswith(".") and last != "i")


def spans(text: str | None, given: set[str] = frozenset(), family: set[str] = frozenset(), more: tuple[set[str], set[str]] = (frozenset(), frozenset())) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source, in order and without overlap; earlier kinds of KINDS win.

    more has given and family names that are known for this text besides the lexicon.
    """
    if not text or text.isspace():
        return []
    flat, start, end = plain(text)
    taken = bytearray(len(flat))
    found: list[tuple[int, int, str]] = []

    def mark(a: int, b: int, kind: str) -> None:
        if b > a and not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            found.append((start[a] if start else a, end[b - 1] if end else b, kind))

    for m in _EMAIL.finditer(flat) if "@" in flat else ():
        mark(*m.span(), "email")
    if _ANY_DIGIT.search(flat):
        for p in _ID:
            for m in p.finditer(flat):
                mark(*m.span("v"), "id_number")
        for p in _PHONE:
            for m in p.finditer(flat):
                if not _COUNTED.search(flat, max(0, m.start() - 24), m.start()):
                    mark(*(m.span("v") if "v" in p.groupindex else m.span()), "phone")
        for m in _LOCAL_PHONE.finditer(flat):
            if not _COUNTED.search(flat, max(0, m.start() - 24), m.start()):
                mark(*m.span(), "phone")
        if start:
            # A run of spelled digits stands for itself: nobody spells a count digit by digit.
            for m in _RUN.finditer(flat):
                if any(text[start[i]].isalpha() for i in range(*m.span())):
                    mark(*m.span(), "phone")
        for m in _CAPITALISED.finditer(flat):
            if not _COUNTED.search(flat, max(0, m.start() - 24), m.start()):
                mark(*m.span(), "street_address")
        for p in _ADDRESS:
            for m in p.finditer(flat):
                mark(*m.span(), "street_address")
    for a, b in _names(flat, given, family, more):
        mark(a, b, "person_name")
    return sorted(found)


def redacted(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """text with a placeholder of its type for each span and every other character as it was."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def lexicon(names: DataFrame, column: str, key: str | None = None, least: int = 2, size: int = LEXICON) -> tuple[set[str], set[str], DataFrame | None]:
    """Given and family names that `least` users have as first and last of two capitalised words, and the rest.

    At most `size` of each, the most frequent, reach the driver; the others are the rest, (half,
    name), None where there are none. Without a key every row is a user of its own.
    """
    halves = [F.struct(F.lit(half).alias("half"), F.regexp_extract(column, _OWN, n).alias("w")) for n, half in ((1, "g"), (2, "f"))]
    both = names.where(F.col(column).rlike(_OWN)).select(*([F.col(key).alias("user")] if key else []), F.explode(F.array(*halves)).alias("x"))
    counted = (both.distinct() if key else both).groupBy("x.half", "x.w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out, whole = [], True
    for half in ("g", "f"):
        rows = counted.where(F.col("half") == half).orderBy(F.desc("n"), "w").limit(size + 1).collect()
        whole &= len(rows) <= size
        out.append({fold(r.w) for r in rows[:size]})
    if whole:
        return out[0], out[1], None
    shared = names.sparkSession.sparkContext.broadcast({"g": frozenset(out[0]), "f": frozenset(out[1])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = [(h, fold(w)) for h, w in zip(d["half"], d["w"])]
            yield pd.DataFrame([r for r in rows if r[1] not in shared.value[r[0]]], columns=["half", "name"])

    return out[0], out[1], counted.select("half", "w").mapInPandas(run, "half string, name string").distinct()


def name_lexicon(names: DataFrame, column: str, least: int = 2, size: int = LEXICON, key: str | None = None) -> tuple[set[str], set[str]]:
    """The two sets of lexicon, without the rest."""
    return lexicon(names, column, key, least, size)[:2]


def find_personal(df: DataFrame, key: str, fields: list[str], given: set[str], family: set[str], own: str | None = None, rest: DataFrame | None = None) -> DataFrame:
    """(key, field_name, kinds, redacted): each non-null field with the kinds found in it and its redacted text.

    kinds is a list without repeats in the order of KINDS, empty where nothing was found. Rows
    without a key are left out, a record delivered twice is read twice, an empty table gives no
    rows, and columns besides the named ones are ignored. The name in the column own is known in
    the texts of its row. Whole texts are read, row by row, without a shuffle; the lexicon that is
    broadcast is bounded. With a rest of the lexicon (see lexicon), the words of the texts that
    are not in the broadcast part are joined with it by a shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast((frozenset(given), frozenset(family)))
    kind = dict(df.dtypes)[key]
    name = (F.col(own).cast("string") if own else F.lit(None).cast("string")).alias("_own")
    cells = df.select(F.col(key), name, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x")).select(key, "_own", "x.field_name", "x.text").where(F.col(key).isNotNull() & F.col("text").isNotNull())

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, f = shared.value
        for d in batches:
            words = [{half for m in _TOKEN.finditer(plain(t)[0]) for w in [fold(m[0].rstrip("."))] for half in {w, *w.split("-")} if half} for t in d["text"]]
            rows = [(k, w) for k, found in zip(d[key], words) for w in found if w not in g or w not in f]
            yield pd.DataFrame({key: pd.Series([k for k, _ in rows], dtype=d[key].dtype), "name": pd.Series([w for _, w in rows], dtype=object)})

    if rest is not None:
        met = spread(cells, key).mapInPandas(candidates, f"{key} {kind}, name string").distinct().join(rest, "name")
        met = met.groupBy(key).agg(F.collect_set(F.when(F.col("half") == "g", F.col("name"))).alias("_g"), F.collect_set(F.when(F.col("half") == "f", F.col("name"))).alias("_f"))
        cells = cells.join(met, key, "left")
    else:
        cells = cells.withColumn("_g", F.lit(None).cast("array<string>")).withColumn("_f", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, f = shared.value
        for d in batches:
            kinds, texts = [], []
            for t, o, more_g, more_f in zip(d["text"], d["_own"], d["_g"], d["_f"]):
                m = _DISPLAYED.match(o) if isinstance(o, str) else None
                more = [set(x) if x is not None else set() for x in (more_g, more_f)]
                for n in (0, 1) if m else ():
                    more[n].add(fold(m[n + 1]))
                found = spans(t, g, f, more)
                has = {x[2] for x in found}
                kinds.append([k for k in KINDS if k in has])
                texts.append(redacted(t, found))
            yield pd.DataFrame({key: d[key], "field_name": d["field_name"], "kinds": kinds, "redacted": texts})

    return spread(cells, key).mapInPandas(run, f"{key} {kind}, field_name string, kinds array<string>, redacted string")
