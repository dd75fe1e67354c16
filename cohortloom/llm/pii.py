"""Personal information in free text: found by type and place, replaced by typed, linkable placeholders.

Numbers are found by their formats and validated by their check digits; street addresses and e-mail addresses by
their shapes, whether signs are written, spelled out or encoded; names by a lexicon of given names and surnames in
their usual arrangements, and beyond it where a title, a field's label or the end of a letter tells a person. Every
place that is found gets a pseudonym: validated numbers (and dates of birth, where asked for) pass a keyed Feistel
permutation within their own format, which takes valid ones to valid ones; other values get a keyed hash. Equal values
so stay linked across documents. Nothing that is looked for before a place is cut off at a number of characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.common import exact

#: Distinct given names and surnames that a lexicon may have.
LEXICON_LIMIT = 500_000

# ---- keyed permutations -----------------------------------------------------------------------------------------------


def _round(key: bytes, n: int, value: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d:%d" % (n, value), key=key, digest_size=8).digest(), "big") % size


def permute(value: int, size: int, key: bytes, rounds: int = 8) -> int:
    """A keyed permutation of 0..size-1: a Feistel network over a square that covers the range, walked until inside it."""
    if size < 2:
        return value
    side = int(size**0.5)
    while side * side < size:
        side += 1
    while True:
        left, right = divmod(value, side)
        for n in range(rounds):
            left, right = right, (left + _round(key, n, right, side)) % side
        value = left * side + right
        if value < size:
            return value


def permute_digits(text: str, key: bytes, keep: int = 0) -> str:
    """The digits of a text permuted in place, but for the first `keep` ones; other signs stay where they are."""
    places = [i for i, c in enumerate(text) if c in "0123456789"][keep:]
    if not places:
        return text
    size = 10 ** len(places)
    new = str(permute(int("".join(text[i] for i in places)), size, key)).zfill(len(places))
    out = list(text)
    for i, c in zip(places, new):
        out[i] = c
    return "".join(out)


def permute_date(day: date, key: bytes, first: date = date(1900, 1, 1), last: date = date(2099, 12, 31)) -> date:
    """A date permuted among the days of a span; dates outside of it stay."""
    if not first <= day <= last:
        return day
    return first + timedelta(permute((day - first).days, (last - first).days + 1, key))


# Words before a date that make it one of birth.
BORN = re.compile(r"(?i)(?<![^\W_])(?:born(?: on)?|d\.?o\.?b\.?|date[ _]of[ _]birth|birth[ _]?date|birthday|geboren(?: am)?|geb\.|geburtsdatum|née? le|nacid[oa] el|nacimiento)['\"]?\s?[:=]?\s?['\"]?(\d{4}-\d{2}-\d{2}|\d{1,2}([./-])\d{1,2}\2\d{4})(?!\d)")


def _date_parts(text: str) -> tuple[date, str] | None:
    """A date and the way it is written: year first, or day first unless only month first is one."""
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%d-%m-%Y", "%m/%d/%Y", "%m-%d-%Y"):
        try:
            return datetime.strptime(text, form).date(), form
        except ValueError:
            continue
    return None


def permute_date_text(text: str, key: bytes) -> str:
    """A date permuted as permute_date does, written as it was; a text that is no date stays."""
    parts = _date_parts(text)
    return permute_date(parts[0], key).strftime(parts[1]) if parts else text


# ---- numbers ----------------------------------------------------------------------------------------------------------

# The check letters of Spanish identity numbers.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def nhs_check(nine: str) -> int | None:
    """The tenth digit of a British health number, None where there is none."""
    rest = 11 - sum(int(c) * (10 - i) for i, c in enumerate(nine)) % 11
    return {11: 0, 10: None}.get(rest, rest)


def nie_letter(first: str, seven: str) -> str:
    """The last letter of a Spanish foreigner's number."""
    return DNI_LETTERS[int("XYZ".index(first) * 10**7 + int(seven)) % 23]


def nino_prefix(two: str) -> bool:
    """Whether two letters can begin a British insurance number; QQ stands for one in examples and forms."""
    return two == "QQ" or not (set(two) & set("DFIQUV") or two[1] == "O" or two in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ"))


def ssn_valid(nine: str) -> bool:
    return nine[:3] not in ("000", "666") and nine[3:5] != "00" and nine[5:] != "0000"


def luhn_check(digits: str) -> int:
    """The digit that completes a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


NUMBER = re.compile(
    r"""(?<![A-Za-z0-9_.+/#-])(?:
    (?P<dni>[0-9]{8}-?[A-Z](?![A-Za-z0-9]))
  | (?P<ssn>[0-9]{3}(?:-[0-9]{2}-|[ ][0-9]{2}[ ])[0-9]{4}(?![0-9-]))
  | (?P<nanp>(?:(?:00)?1[-. ])?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-]))
  | (?P<uk>0(?:[0-9]{4}[ ][0-9]{6}|[0-9]{3}[ ][0-9]{3}[ ][0-9]{4}|[0-9]{2}[ ][0-9]{4}[ ][0-9]{4}|[0-9]{2}[ ][0-9]{5}[ ][0-9]{3})(?![0-9]))
  | (?P<nhs>[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}(?![0-9-]))
  | (?P<card>[0-9]{4}([ -]?)[0-9]{4}\7[0-9]{4}\7[0-9]{4}(?![0-9-]))
  | (?P<ten>[4679][0-9]{9}(?![\w-]|\.[0-9]))
  | (?P<nino>[A-Z]{2}[ ]?[0-9]{2}[ ]?[0-9]{2}[ ]?[0-9]{2}[ ]?[A-D](?![A-Za-z0-9]))
  | (?P<nie>[XYZ]-?[0-9]{7}-?[A-Z](?![A-Za-z0-9]))
  | (?P<passport>[A-Z][0-9]{8}(?![A-Za-z0-9]))
    )
  | (?<![\w.)+])(?P<intl>\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9]))""",
    re.X,
)
# Where a number may begin, by its first signs: a cheap pass before the forms are tried.
NUMBER_START = re.compile(r"[0-9(A-Z](?<![A-Za-z0-9_.+/#-].)(?:(?<=[0-9])(?=[0-9 .()-]{6})|(?<=\()(?=[0-9]{3}\))|(?<=[A-Z])(?=[A-Z]?[ -]?[0-9]))|\+(?=[0-9])")
# Words before a number that tell it isn't a person's.
NO_PERSON = re.compile(r"(?i)(?:\b(?:order|orders|sku|ticket|run|build|version|sha|commit|issue|invoice|serial|batch|job|seed|isbn|doi|part|lot)(?: ?(?:no|nr|number|id))?\.?[ :=#]{1,3})$")


def _number_kind(m: re.Match) -> str | None:
    kind, s = m.lastgroup, m.group()
    if kind == "intl":
        return "phone" if 9 <= len(_digits(s)) <= 15 else None
    if kind in ("nanp", "uk"):
        return "phone"
    d = _digits(s)
    if kind == "dni":
        return "id_number" if DNI_LETTERS[int(d) % 23] == s[-1] else None
    if kind == "ssn":
        return "id_number" if ssn_valid(d) else None
    if kind == "nie":
        return "id_number" if nie_letter(s[0], d) == s[-1] else None
    if kind == "nino":
        return "id_number" if nino_prefix(s[:2]) else None
    if kind in ("nhs", "ten"):
        return "id_number" if nhs_check(d[:9]) == int(d[9]) else None
    if kind == "card":
        return "id_number" if luhn_check(d[:-1]) == int(d[-1]) else None
    return "id_number"


# ---- e-mail -----------------------------------------------------------------------------------------------------------

AT_SIGNS = ("@", "%40", "&#64;", "&#x40;", "&commat;", " AT ", " at ")
AT_BRACKETS = re.compile(r"[\[({<]\s?(?:at|AT|At)\s?[\])}>] ?")
DOT = r"(?:\.|%2E|&#46;| ?[\[({<]\s?(?:dot|DOT|Dot)\s?[\])}>] ?| DOT | dot )"
DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])")

# ---- addresses --------------------------------------------------------------------------------------------------------

# Kinds of street and of unit, and words before a kind that make it no address.
STREET = re.compile(r" (?:(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Court|Ct|Crescent|Cres|Drive|Dr|Way|Place|Pl|Terrace|Gardens|Grove|Boulevard|Blvd|Square|Sq|Row|Walk|Mews|Hill)\b\.?|(?:rue|avenue|boulevard|chemin|impasse|quai) (?=[A-Zd-l]))")
UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room|Wohnung|Piso|Appt)\.? ?#?\d{1,4}[A-Za-z]?,? )?"
BEFORE_ENGLISH = re.compile(rf"(?<!\w)({UNIT}\d{{1,4}}[A-Za-z]?,? (?!(?:Day|Week|Month|Year|Hour|Minute|Period|Quarter|Section)\b)[A-Z][\w'’-]+(?: [A-Z][\w'’-]+){{0,2}})$")
BEFORE_FRENCH = re.compile(rf"(?<!\w)({UNIT}\d{{1,4}}(?: ?(?:bis|ter|[A-Za-z]))?,?)$")
AFTER_FRENCH = re.compile(r"(?:de la |des |du |de |d['’]|l['’])?[A-ZÀ-Ý][\w'’]+(?:[ -][A-ZÀ-Ý][\w'’]+){0,3}")
BEFORE_GERMAN = re.compile(rf"(?<!\w)({UNIT}[A-ZÄÖÜ][\w-]*?)$")
AFTER_GERMAN = re.compile(r" \d{1,4}(?: ?[A-Za-z])?(?!\w)")
BEFORE_SPANISH = re.compile(rf"(?<!\w)({UNIT})$")
AFTER_SPANISH = re.compile(r"(?:de los |de las |de la |del |de |do |da )?[A-ZÀ-Ý][\w'’-]+(?: [A-ZÀ-Ý][\w'’-]+){0,3},? (?:n[º°o]\.? ?)?\d{1,4}(?!\w)")
GERMAN = ("straße", "strasse", "str.", "weg", "allee", "platz", "gasse")
SPANISH = ("calle ", "avenida ", "avda. ", "plaza ", "paseo ", "camino ", "rua ", "travessa ")

# ---- names ------------------------------------------------------------------------------------------------------------

GIVEN_BEFORE = re.compile(r"(?<![\w.@+-])([^\W\d_][\w'’-]+)((?: [^\W\d_]\.)*) $")
INITIALS_BEFORE = re.compile(r"(?<![\w.@+-])(?<!\w['’])((?:[^\W\d_]\.[ -]?)*(?:[^\W\d_]\.|[A-ZÀ-Ý])) $")
GIVEN_AFTER = re.compile(r",? ([^\W\d_]+(?:-[^\W\d_]+)?)(\.?)(?![\w@])")
SURNAME_AFTER = re.compile(r"(?: [^\W\d_]\.)* ([^\W\d_][\w'’-]*[^\W\d_])(?![\w@])")
# Titles, and labels of fields that hold a person; where one stands before, one half of a name may be unknown.
TITLE = r"(?:Mrs?|Ms|Miss|Dr|Prof|Professor|Herr|Frau|Sra?|Mme|Mlle)\.?"
LABEL = r"(?i:name|holder|author|owner|contact|patient|customer|employee|attn|(?:signed[ -]off|reported|written|prepared|reviewed)[ -]by)"
PERSON_BEFORE = re.compile(rf"""(?:(?<![\w.@+-]){TITLE} |(?<![^\W_]){LABEL}['"]?\s?[:=]\s?['"]?(?:{TITLE} )?)$""")
ONLY_TITLE = re.compile(TITLE)

# Names of which neither half is known: behind a title or a label, or under the end of a letter.
WORD_OF_NAME = r"[^\W\d_a-z][^\W\d_]*[^\W\d_A-Z][^\W\d_]*(?:[-'’][^\W\d_]+)*"
STRANGER = rf"({WORD_OF_NAME}(?: [^\W\d_]\.)*(?: (?:van|von|de|der|den|da|di|del|la|le|zu))* {WORD_OF_NAME})(?![\w@]|\(| [^\W\d_a-z])"
BEHIND_TITLE = re.compile(rf"(?<![\w.@+-])(?:(?:Mrs?|Ms|Miss|Dr|Prof|Professor|Herr|Frau|Sra?|Mme|Mlle)\.? )+{STRANGER}")
BEHIND_LABEL = re.compile(rf"(?<![^\W_])(?i:patient|customer|employee|attn|contact|(?:signed[ -]off|reported|written|prepared|reviewed)[ -]by)(?:[ _](?i:name))?['\"]?\s?[:=]\s?['\"]?{STRANGER}")
UNDER_LETTER = re.compile(rf"(?i:regards|sincerely|yours truly|best wishes|grüßen|grüße|cordialement|saludos),?[ \t]*\n+[ \t>#]*{STRANGER}[ \t]*(?:\n|$)")

# What the automaton looks for to try these forms.
TOLD_BY = {
    "title": ("mr ", "mr.", "mrs ", "mrs.", "ms ", "ms.", "miss ", "dr ", "dr.", "prof ", "prof.", "professor ", "herr ", "frau ", "sr ", "sr.", "sra ", "sra.", "mme ", "mme.", "mlle ", "mlle."),
    "label": ("patient", "customer", "employee", "attn", "contact", *(f"{a}{b}by" for a in ("signed off", "signed-off", "reported", "written", "prepared", "reviewed") for b in " -")),
    "letter": ("regards", "sincerely", "yours truly", "best wishes", "grüßen", "grüße", "cordialement", "saludos"),
}
TOLD_FORMS = {"title": BEHIND_TITLE, "label": BEHIND_LABEL, "letter": UNDER_LETTER}

ESCAPED = re.compile(r"(?:\x1b|\\u001[bB])\[[0-9;]*[A-Za-z]|\\[nrt]")


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def _lower(text: str) -> str:
    """Lower case of the same length, with one kind of apostrophe."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.replace("’", "'")


def _back(t: str, end: int, words: int) -> int:
    """Where the last `words` words of a line before a place begin, however long they are."""
    at = end
    for _ in range(words):
        size, found = 64, -1
        while found < 0 and size // 2 < at:
            low = max(0, at - size)
            found = max(t.rfind(" ", low, at), t.rfind("\n", low, at))
            size *= 8
        if found < 0:
            return 0
        at = found
        if t[at] == "\n":
            return at + 1
    return at


def _ats(t: str) -> list[tuple[int, int]]:
    """Places of at signs, written, spelled out or encoded, that don't overlap."""
    found = []
    for sign in AT_SIGNS:
        at = t.find(sign)
        while at >= 0:
            found.append((at, at + len(sign)))
            at = t.find(sign, at + len(sign))
    found += [(m.start() - (m.start() > 0 and t[m.start() - 1] == " "), m.end()) for m in AT_BRACKETS.finditer(t)]
    out, last = [], 0
    for start, end in sorted(found):
        if start >= last:
            out.append((start, end))
            last = end
    return out


def _local_start(t: str, end: int) -> int:
    """Where the local part before an at sign begins."""
    at = end
    while at and (t[at - 1].isalnum() or t[at - 1] in "_.+-" or t[at - 1] == "%" and t[at : at + 2].lower() in ("2b", "2e")):
        at -= 1
    return at


@dataclass(frozen=True)
class Lexicon:
    """Given names and surnames, in lower case. Any stem with any ending is a surname, too, though it isn't listed."""

    given: frozenset[str]
    surnames: frozenset[str]
    stems: frozenset[str] = frozenset()
    endings: frozenset[str] = frozenset()

    @classmethod
    def of(cls, given: Iterable[str], surnames: Iterable[str], least: int = 3, limit: int = 100_000) -> Lexicon:
        """From names as written. Surnames made of a stem and an ending that each occur in `least` or more names are
        joined by all other pairs of such stems and endings: up to `limit` pairs are listed, more are put together where
        a text has them, with the same results."""
        given = frozenset(_lower(x.strip()) for x in given if x and x.strip())
        known = {_lower(x.strip()) for x in surnames if x and x.strip()}
        stems: dict[str, set[str]] = {}
        endings: dict[str, set[str]] = {}
        for name in known:
            for cut in range(3, len(name) - 1):
                stems.setdefault(name[:cut], set()).add(name[cut:])
                endings.setdefault(name[cut:], set()).add(name[:cut])
        parts: set[tuple[str, str]] = set()
        for name in known:
            cuts = [(len(stems[name[:c]]) * len(endings[name[c:]]), name[:c], name[c:]) for c in range(3, len(name) - 1) if len(stems[name[:c]]) >= least and len(endings[name[c:]]) >= least]
            if cuts:
                parts.add(max(cuts)[1:])
        a, b = {x for x, _ in parts}, {y for _, y in parts}
        if len(a) * len(b) > limit:
            return cls(given, frozenset(known), frozenset(a), frozenset(b))
        return cls(given, frozenset(known | {x + y for x in a for y in b}))


class Finder:
    """Finds personal information in one text at a time."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for tag, texts in TOLD_BY.items():
            for s in texts:
                self.automaton.add_word(s, (tag, len(s)))
        for s in lexicon.given:
            self.automaton.add_word(s, ("given", len(s)))
        for s in SPANISH:
            self.automaton.add_word(s, ("spanish", len(s)))
        for s in GERMAN:
            self.automaton.add_word(s, ("german", len(s)))
        for s in lexicon.surnames:
            self.automaton.add_word(s, ("surname", len(s)))
        self.automaton.make_automaton()
        self.stems = None
        if lexicon.stems:
            self.stems = ahocorasick.Automaton()
            for s in lexicon.stems:
                self.stems.add_word(s, len(s))
            self.stems.make_automaton()
        self.ending_sizes = sorted({len(s) for s in lexicon.endings})

    def find(self, text: str | None, dates: bool = False) -> list[tuple[str, int, int]]:
        """(type, start, end) of every place, in order of start; places of one type don't overlap. With dates, those of birth, too."""
        if not text:
            return []
        t = ESCAPED.sub(_blank, text) if "\\" in text or "\x1b" in text else text
        found = self._emails(t)
        mails = list(found)
        found += self._numbers(t)
        found += self._words(t, mails)
        found += self._streets(t)
        if dates:
            found += [("date", *m.span(1)) for m in BORN.finditer(t) if _date_parts(m.group(1))]
        found.sort(key=lambda x: (x[1], -x[2]))
        out: list[tuple[str, int, int]] = []
        for x in found:
            if any(y[1] <= x[1] < y[2] for y in out[-3:]):
                continue
            out.append(x)
        return out

    def _emails(self, t: str) -> list[tuple[str, int, int]]:
        out = []
        for at, after in _ats(t):
            start = _local_start(t, at)
            while start < at and t[start] in ".-+":
                start += 1
            domain = DOMAIN.match(t, after) if start < at else None
            if not domain or t.startswith((":~", ":/"), domain.end()):
                continue
            if t[at:after] in (" at ", " AT ") and not re.search(r"(?i) dot |[\[({<]\s?dot", domain.group()):
                continue
            out.append(("email", start, domain.end()))
        return out

    def _numbers(self, t: str) -> list[tuple[str, int, int]]:
        out = []
        last = 0
        for at in NUMBER_START.finditer(t):
            m = NUMBER.match(t, at.start()) if at.start() >= last else None
            if not m:
                continue
            last = m.end()
            kind = _number_kind(m)
            if kind and not NO_PERSON.search(t, _back(t, m.start(), 4), m.start()):
                out.append((kind, m.start(), m.end()))
        return out

    def _hits(self, low: str) -> Iterable[tuple[int, tuple[str, int]]]:
        """(last place, (tag, size)) of listed words and of stems with an ending, by last place, the longest first."""
        if self.stems is None:
            return self.automaton.iter(low)
        hits = list(self.automaton.iter(low))
        for end, size in self.stems.iter(low):
            start = end - size + 1
            if start and (low[start - 1].isalnum() or low[start - 1] in "_.+@-"):
                continue
            for more in self.ending_sizes:
                name = low[start : end + 1 + more]
                if low[end + 1 : end + 1 + more] in self.lexicon.endings and name not in self.lexicon.surnames:
                    hits.append((end + more, ("surname", len(name))))
        return sorted(set(hits), key=lambda x: (x[0], -x[1][1]))

    def _words(self, t: str, mails: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        last = -1
        low, givens, told = _lower(t), [], []
        for end, (tag, size) in self._hits(low):
            start, end = end - size + 1, end + 1
            if tag in TOLD_FORMS:
                told += [m.span(1)] if (m := TOLD_FORMS[tag].match(t, start)) else []
                continue
            if tag == "given" or (tag == "surname" and low[start:end] in self.lexicon.given):
                givens.append((start, end))
            if tag == "given":
                continue
            if tag == "surname":
                if (start and (t[start - 1].isalnum() or t[start - 1] in "_.+@-")) or (end < len(t) and (t[end].isalnum() or t[end] in "_@")):
                    continue
                span = self._name(t, start, end)
                if span and span[0] > last and not any(a <= span[0] < b for _, a, b in mails):
                    out.append(("name", *span))
                    last = span[1] - 1
            elif tag == "german":
                after = AFTER_GERMAN.match(t, end)
                before = BEFORE_GERMAN.search(t, _back(t, start, 6), start) if after else None
                if before and len(before.group(1)) > 2:
                    out.append(("address", before.start(1), after.end()))
            elif not (start and (t[start - 1].isalnum() or t[start - 1] == "_")) and t[start].isupper():
                after = AFTER_SPANISH.match(t, end)
                before = BEFORE_SPANISH.search(t, _back(t, start, 5), start) if after else None
                if after:
                    out.append(("address", before.start(1) if before else start, after.end()))
        taken = [x[1:] for x in [*out, *mails] if x[0] in ("name", "email")]
        for start, end in givens:
            after = SURNAME_AFTER.match(t, end)
            if after and after.group(1)[0].isupper() and self._told(t, start) and not any(a < after.end() and start < b for a, b in taken):
                out.append(("name", start, after.end()))
                taken.append((start, after.end()))
        for start, end in told:
            if not any(a < end and start < b for a, b in taken):
                out.append(("name", start, end))
                taken.append((start, end))
        return out

    def _told(self, t: str, start: int) -> bool:
        """Whether a title or a label tells that a person's name begins here."""
        return PERSON_BEFORE.search(t, _back(t, start, 5), start) is not None

    def _name(self, t: str, start: int, end: int) -> tuple[int, int] | None:
        before = GIVEN_BEFORE.search(t, _back(t, start, 12), start) if start and t[start - 1] == " " else None
        if before and _lower(before.group(1)) in self.lexicon.given:
            return before.start(1), end
        if before and before.group(1)[0].isupper() and not ONLY_TITLE.fullmatch(before.group(1)) and self._told(t, before.start(1)):
            return before.start(1), end
        initials = INITIALS_BEFORE.search(t, _back(t, start, 12), start) if start and t[start - 1] == " " else None
        if initials:
            return initials.start(1), end
        after = GIVEN_AFTER.match(t, end)
        if after:
            word = after.group(1)
            comma = t[end] == ","
            if _lower(word) in self.lexicon.given and not after.group(2).startswith("@"):
                return start, after.end(1)
            if comma and len(word) == 1 and after.group(2) and word.isupper():
                return start, after.end()
        return None

    def _streets(self, t: str) -> list[tuple[str, int, int]]:
        out = []
        for m in STREET.finditer(t):
            if m.group().endswith(" ") and m.group()[1].islower():
                before, after = BEFORE_FRENCH.search(t, _back(t, m.start(), 6), m.start()), AFTER_FRENCH.match(t, m.end())
                if before and after:
                    out.append(("address", before.start(1), after.end()))
                continue
            before = BEFORE_ENGLISH.search(t, _back(t, m.start(), 9), m.start())
            if before:
                out.append(("address", before.start(1), m.end()))
        return out


# ---- placeholders -----------------------------------------------------------------------------------------------------


def _walked(text: str, key: bytes, keep: int, valid: Callable[[str], bool]) -> str:
    """Digits but the first `keep` permuted until they are valid: among the valid texts this is a permutation, too."""
    while True:
        text = permute_digits(text, key, keep)
        if valid(_digits(text)):
            return text


def _phone(value: str, key: bytes) -> str:
    """A number of the same country and format: what tells the country, or the trunk, stays."""
    d = _digits(value)
    nanp = re.fullmatch(r"(?:(?:00)?1[-. ])?(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}", value)
    if nanp:
        first = len(d) - 10
        return _walked(value, key, first, lambda x: x[first] not in "01" and x[first + 3] not in "01" if d[first] not in "01" and d[first + 3] not in "01" else True)
    code = re.match(r"\+\d{1,3}(?=\D)", value)
    return permute_digits(value, key, keep=len(code.group()) - 1 if code else 1 if d.startswith("0") else 0)


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """What stands for a value: digits permuted within their format, valid ones to valid ones; dates among dates; else a keyed hash of 128 bits."""
    d = _digits(value)
    if kind == "date":
        return permute_date_text(value, key)
    if kind == "phone":
        return _phone(value, key)
    if kind == "id_number":
        if re.fullmatch(r"\d{8}-?[A-Z]", value):
            new = permute_digits(value, key)
            return new[:-1] + DNI_LETTERS[int(_digits(new)) % 23]
        if re.fullmatch(r"[XYZ]-?\d{7}-?[A-Z]", value):
            new = permute_digits(value, key)
            return new[:-1] + nie_letter(new[0], _digits(new))
        if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", value):
            return _walked(value, key, 0, ssn_valid)
        if len(d) == 10:
            return _rechecked(value, key, nhs_check)
        if len(d) == 16:
            return _rechecked(value, key, luhn_check)
        return permute_digits(value, key)
    return hashlib.blake2b(_lower(value).encode("utf-8", "surrogatepass"), key=key, digest_size=16).hexdigest()


def _rechecked(value: str, key: bytes, check: Callable[[str], int | None]) -> str:
    """All digits but the last permuted until they have a check digit, which then is the last."""
    last = max(i for i, c in enumerate(value) if c in "0123456789")
    head = value[:last]
    while True:
        head = permute_digits(head, key)
        c = check(_digits(head))
        if c is not None:
            return head + str(c) + value[last + 1 :]


def redact(text: str, places: list[tuple[str, int, int]], key: bytes) -> str:
    """The text with each place as <TYPE:pseudonym>; all else is unchanged."""
    out, at = [], 0
    for kind, start, end in places:
        out += [text[at:start], f"<{kind.upper()}:{pseudonym(kind, text[start:end], key)}>"]
        at = end
    return "".join([*out, text[at:]])


# ---- Spark ------------------------------------------------------------------------------------------------------------


def lexicon_of(people: DataFrame, given: str = "FirstName", surname: str = "LastName") -> Lexicon:
    """The distinct names of a table of people. Raises beyond LEXICON_LIMIT names, as the lexicon goes to every task."""
    people = exact(people, [given, surname])
    rows = people.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col(given).alias("v")), F.struct(F.lit(1).alias("k"), F.col(surname).alias("v")))).alias("x")).select("x.k", "x.v").filter("v is not null").distinct().limit(LEXICON_LIMIT + 1).collect()
    if len(rows) > LEXICON_LIMIT:
        raise ValueError(f"over {LEXICON_LIMIT} distinct names; pass a Lexicon of your own")
    return Lexicon.of([r.v for r in rows if r.k == 0], [r.v for r in rows if r.k == 1])


_READY: dict[int, Finder] = {}


def _finder(lexicon) -> Finder:
    """The finder of a broadcast lexicon, made once in a worker."""
    key = hash(lexicon.value)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Finder(lexicon.value)
    return _READY[key]


def _pepper(secret: str) -> bytes:
    return hashlib.blake2b(secret.encode(), digest_size=32).digest()


def find_pii(df: DataFrame, lexicon: Lexicon, secret: str, key: str = "doc_id", text: str = "text", dates: bool = False) -> DataFrame:
    """(key, pii_type, start_pos, end_pos, pseudonym): every place, by code points from 0, and what stands for it; nothing is shuffled.

    The pseudonyms depend on `secret` only: whoever has it can link and undo them. Defined results: null and empty
    texts have no places; repeats count each; texts are read whole; a null key stays null.
    """
    df = exact(df, [key, text])
    kind = dict(df.dtypes)[key]
    pepper, shared = _pepper(secret), df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        stand_in = lru_cache(100_000)(pseudonym)
        for b in batches:
            rows, types, starts, ends, names = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                for what, start, end in finder.find(t, dates):
                    rows.append(i)
                    types.append(what)
                    starts.append(start)
                    ends.append(end)
                    names.append(stand_in(what, t[start:end], pepper))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(types, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(names, pa.string())], ["k", "pii_type", "start_pos", "end_pos", "pseudonym"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, pii_type string, start_pos bigint, end_pos bigint, pseudonym string")


def redact_pii(df: DataFrame, lexicon: Lexicon, secret: str, key: str = "doc_id", text: str = "text", dates: bool = False) -> DataFrame:
    """(key, text, n_places): texts with typed placeholders, which hold the pseudonyms of find_pii. A null text stays null."""
    df = exact(df, [key, text])
    kind = dict(df.dtypes)[key]
    pepper, shared = _pepper(secret), df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts, counts = [], np.zeros(part.num_rows, np.int32)
                for i, t in enumerate(part.column(1).to_pylist()):
                    places = finder.find(t, dates)
                    counts[i] = len(places)
                    texts.append(redact(t, places, pepper) if places else t)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts)], ["k", "t", "n"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{text}` string, n_places int")
