"""Personal information in free text (problem 5): contextual extraction that bootstraps itself.

One pass over the texts collects candidate spans with features: the words beside them (external patterns) and their
own form (internal patterns). Seeds label a part of the candidates: listed name parts, a few words that name a number
or introduce a phone number, words of goods and firms as counter-examples. Spark then scores the graph of patterns and
candidates in rounds: a pattern is as sure as the share of its labelled instances that agree, a candidate takes the
label of its surest pattern, and newly labelled candidates vote for further patterns. So unknown number formats,
contexts and names are found from what they have in common with known ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Workspace, table

#: A pattern counts from so many distinct instances and this share of agreement; rounds of scoring.
SUPPORT, SURE, ROUNDS = 3, 0.9, 3
#: A word in lower case this many times as often as with a capital inside a sentence is no name where it has one.
SMALL = 20
#: Parts that the candidates of one pattern, or the rows of one candidate, are cut into.
SLICES = 8
#: Words kept as ordinary vocabulary, at most: bounds what every worker holds.
VOCABULARY = 50_000
#: Name parts read from the given list, at most.
NAME_LIST = 100_000

# Seeds of the bootstrap.
ID_WORDS = ["passport", "ssn", "licence", "license", "permit", "insurance", "patient", "health", "identity", "tax", "security", "ni", "nhs", "id"]
PHONE_WORDS = ["tel", "phone", "call", "ring", "mobile", "fax"]
GOODS_WORDS = ["order", "lot", "serial", "version", "room", "article", "invoice", "po", "part", "model", "batch", "ticket"]
FIRM_WORDS = ["stores", "freight", "dairy", "software", "foundation", "sons", "ltd", "inc", "gmbh", "llc", "plc", "company", "co", "group", "bros"]
CALENDAR = [
    *"january february march april may june july august september october november december".split(),
    *"monday tuesday wednesday thursday friday saturday sunday".split(),
]
TITLES = ["dr", "mr", "mrs", "ms", "miss", "prof", "sir", "herr", "frau", "mme", "sra"]
HEADS = "sensitive label text fwd re edit update note subject".split()
PARTICLES = ["van", "der", "den", "von", "de", "del", "della", "di", "da", "du", "la", "le", "ten", "ter"]
STREET_WORDS = [
    *"street st road rd avenue ave lane ln close court ct drive dr way gardens mews terrace place square crescent".split(),
    *"boulevard blvd grove walk row parade quay".split(),
]
DIGIT_WORDS = "zero one two three four five six seven eight nine oh double triple".split()
#: kinds of street that are seeds; the others are likely ones, which patterns may confirm or refuse
SEED_STREETS = "street st road rd lane avenue ave strasse straße rue".split()
STREET_ENDS = ["strasse", "straße", "weg", "platz", "allee", "gasse", "straat", "laan"]
STREET_STARTS = ["rue", "avenue", "boulevard", "chemin", "impasse", "allée", "calle", "via"]
UNIT_WORDS = ["flat", "apt", "apartment", "unit", "suite", "house", "studio"]

LABELS = ["email", "phone", "id_number", "address", "name", "goods", "firm", "handle", "place"]
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: cuts a text into gaps and words; the second says the same of ASCII text
_CUT, _CUT_ASCII = re.compile(f"({_WORD.pattern})"), re.compile(r"([A-Za-z]+(?:'[A-Za-z]+)*)")
_NOT_LOCAL = re.compile(r"[^\w.+%-]")
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_HANDLE = re.compile(r"\w+")
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_AT = r"(?:\s?[@＠]\s?|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)"
_SPELT = re.compile(rf"(?<!\w)\w[\w+%-]*(?:{_DOT}[\w+%-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+(?!\w|[+%]\w)(?!{_AT})", re.IGNORECASE)
#: what any match of _SPELT with a spelt sign holds; for text in lower case, where a literal can be searched for first
_SPELT_SIGN = rf"at(?<=[\s\[({{]at)(?:\s?[\])}}]\s?|\s)[\w-]+{_DOT}[\w-]"
_SIGN_LOWER, _SIGN = re.compile(_SPELT_SIGN), re.compile(_SPELT_SIGN, re.IGNORECASE)
#: an address in which neither sign is spelt in a way of its own: it may be a handle or a place
_PLAIN_AT = re.compile(r"(?P<local>\S+)\sat\s(?P<domain>[\w.-]+)", re.IGNORECASE)
_DIGITS, _DIGITS_ASCII = re.compile(r"\d+"), re.compile(r"[0-9]+")
_NO = r"\d{1,4}[a-z]?(?:\s?[-/–]\s?\d{1,4}[a-z]?)?"
_TOWN = r"(?P<town>,\s[^\W\d_][\w'’-]+(?:\s\d{4,5})?)?"
#: from a house number on: words and a kind of street, or a kind of street and a word
_AFTER_NO = re.compile(
    rf"{_NO},?\s(?:(?P<words>(?:[^\W\d_][\w'’-]*\s){{1,3}}?)(?P<kind>{'|'.join(STREET_WORDS)})\b\.?{_TOWN}"
    rf"|(?P<first>{'|'.join(STREET_STARTS)})\s(?:(?:de|du|des|la|le)\s)*[^\W\d_][\w'’-]+)",
    re.IGNORECASE,
)
#: a house number and capitalised words of which none names a known kind of street
_OPEN_KIND = re.compile(rf"{_NO},?\s(?P<words>[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+){{1,2}})(?!\w)")
_NO_END = re.compile(rf"{_NO}(?!\w){_TOWN}", re.IGNORECASE)
#: what may stand before a house number: a flat or house part, or a street name that ends in its kind
_UNIT_END = re.compile(rf"\b(?:{'|'.join(UNIT_WORDS)})\.?\s(?:{_NO},?\s)?$", re.IGNORECASE)
_NAME_END = re.compile(rf"[^\W\d_][\w'’-]*(?:{'|'.join(STREET_ENDS)})\s$", re.IGNORECASE)
_ENDS = tuple(STREET_ENDS)
_UNIT_NO_END = re.compile(rf"\b(?:{'|'.join(UNIT_WORDS)})\.?\s{_NO},?\s$", re.IGNORECASE)
_DIGIT_WORD = "|".join(DIGIT_WORDS)
_CHUNK = r"[A-Za-z]{0,6}\d[\dA-Za-z]*"
_NUMBER = re.compile(
    rf"(?<![\w@.])(?:(?!(?:on|no|at|to|by|is|id|ni|or|in|of|my)\b)[A-Za-z]{{2}} (?=\d\d ?\d\d ?\d\d ?[A-Za-z]?\b)|[A-Za-z]{{1,4}}[/-](?=\d))?[+(]{{0,2}}{_CHUNK}"
    rf"(?:(?: ?[-/.] ?|[ \xa0]|\) ?-?| ?\(){{1,2}}{_CHUNK})*",
    re.IGNORECASE,
)
_DIGIT_WORDS = frozenset(DIGIT_WORDS)
_HEADS, _FIRMS = frozenset(HEADS), frozenset(FIRM_WORDS)
_NEVER = frozenset(CALENDAR) | frozenset(TITLES)
_SPOKEN = re.compile(rf"\b(?:{_DIGIT_WORD})(?:[ ,-]{{1,2}}(?:{_DIGIT_WORD})\b){{6,}}", re.IGNORECASE)
_NOT_WORD = re.compile(r"\W")
_AMOUNT = re.compile(r"\d+[.,]\d{1,2}")
_DIGIT = re.compile(r"\d")
_NOT_DIGIT = re.compile(r"\D+")
_ANY_AT, _ANY_DOT = re.compile(_AT, re.IGNORECASE), re.compile(_DOT, re.IGNORECASE)
_BARE_AT, _BARE_DOT = re.compile(r"\sat\s", re.IGNORECASE), re.compile(r"\sdot\s", re.IGNORECASE)
_FORM = re.compile(r"[^\W\d_]+")
#: blanks all ASCII characters that no word holds
_BLANK = bytes(c if chr(c).isalpha() or chr(c) == "'" else 32 for c in range(128)) + b" " * 128
_LEFT = re.compile(r"[^\W_]+|[^\w\s]")


def _shape(text: str) -> str:
    """Digits as 9, letters as a; a number in words has a shape of its own."""
    if not any(c.isdigit() for c in text):
        return "words"
    return re.sub(r"[^\W\d_]+", lambda m: "a" * min(len(m.group()), 4), re.sub(r"\d", "9", text)).lower()


def _words_before(text: str, at: int) -> list[str]:
    words = _LEFT.findall(text[max(0, at - 60) : at].lower())
    return [w if w.isalpha() else _DIGIT.sub("9", w) for w in words]


def _may_be_spelt(text: str, low: str, known: int) -> bool:
    """Can ``_SPELT`` match anything but the ``known`` plain addresses and handles? Beyond ASCII, lower case may have
    other characters than the text."""
    if text.count("@") + text.count("＠") > known:
        return True
    return bool(_SIGN_LOWER.search(low) if text.isascii() else _SIGN.search(text))


def _signed(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of plain e-mail addresses, and of account handles."""
    mails, handles = [], []
    for sign in "@＠":
        at = text.find(sign)
        while at >= 0:
            start = at
            while start and not _NOT_LOCAL.match(text, start - 1):
                start -= 1
            while start < at and not text[start].isalnum():
                start += 1
            domain = _DOMAIN.match(text, at + 1)
            if start < at and domain:
                mails.append((start, domain.end()))
            elif start == at and (handle := _HANDLE.match(text, at + 1)):
                handles.append((at, handle.end()))
            at = text.find(sign, at + 1)
    return mails, handles


def _free(start: int, end: int, taken: list[tuple[int, int]]) -> bool:
    return all(end <= s or start >= e for s, e in taken)


Candidate = tuple[str, int, int, str, list[str], str | None, str | None]


class _Kinds(dict):
    """Word to its kind: 0 is no part of a name, 1 is one, 2 is one only where it stands inside a sentence; 4 more is a
    digit."""

    def __init__(self, ordinary: frozenset[str], names: dict[str, str], small: frozenset[str]) -> None:
        self.ordinary, self.names, self.small = ordinary, names, small

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:  # words are as many as the texts make them; a worker's memory is not
            self.clear()
        self[word] = kind = self._kind(word) + 4 * (word.lower() in _DIGIT_WORDS)
        return kind

    def _kind(self, word: str) -> int:
        if word in self.ordinary and word not in self.names:
            return 0
        low = word.lower()
        if low.endswith(("'s", "’s")):
            low = low[:-2]
        if low in self.names:
            return 1
        if len(word) < 3 or not word[0].isupper():
            return 0
        if low not in self.ordinary:
            return 1
        return 2 if word[1:].islower() and low not in _NEVER and low not in self.small else 0


class _Words:
    """The words of a text and, where they are asked for, their places.

    In ASCII text what is no letter is blanked, which splits it without a search; places follow from the neighbours, or,
    for a word that is met from left to right with all its copies, from its next occurrence.
    """

    def __init__(self, text: str) -> None:
        self.blanked = ""
        self.starts: dict[int, int] = {}
        if text.isascii():
            blanked = text.encode().translate(_BLANK).decode()
            self.words = blanked.split()
            if "'" not in blanked or not any(w[0] == "'" or w[-1] == "'" or "''" in w for w in self.words if "'" in w):
                self.blanked = f" {blanked} "
                return
        parts = (_CUT_ASCII if text.isascii() else _CUT).split(text)
        self.words = parts[1::2]
        self.starts = dict(enumerate(list(accumulate(map(len, parts)))[::2]))

    def place(self, i: int, after: int) -> None:
        """Find word i, of which all copies are placed from left to right, at or after a place."""
        if i not in self.starts:
            self.starts[i] = self.blanked.index(f" {self.words[i]} ", after)

    def start(self, i: int) -> int:
        if i not in self.starts:
            word = self.words[i]
            if i - 1 in self.starts:
                self.starts[i] = self.blanked.index(word, self.end(i - 1) + 1) - 1
            else:
                self.starts[i] = self.blanked.rindex(word, 0, self.start(i + 1) + 1) - 1
        return self.starts[i]

    def end(self, i: int) -> int:
        return self.start(i) + len(self.words[i])

    def lower(self, i: int) -> str:
        return self.words[i].lower()


class Extractor:
    """Candidates of one text, given the ordinary vocabulary and the listed name parts."""

    def __init__(self, ordinary: frozenset[str], names: dict[str, str], small: frozenset[str] = frozenset()) -> None:
        """``small``: ordinary words that are hardly ever capitalised inside a sentence."""
        self.ordinary = ordinary | frozenset(CALENDAR) | frozenset(TITLES)
        self.names = names
        self.not_towns = self.ordinary | frozenset(UNIT_WORDS)
        #: name parts that are no ordinary words: only these are seeds
        self.seeds = frozenset(names) - self.ordinary
        self.kinds = _Kinds(self.ordinary, names, small)

    def candidates(self, text: str) -> list[Candidate]:
        """(group, start, end, instance, patterns, seed label or None, label if no pattern decides); from 0."""
        low = text.lower()
        mails, handles = _signed(text)
        found = [self._mail(text, s, e, "email", None) for s, e in mails]
        found += [self._mail(text, s, e, "handle", None) for s, e in handles]
        taken = mails + handles
        if _may_be_spelt(text, low, len(taken)):
            at = 0
            while m := _SPELT.search(text, at):
                seed, likely = self._spelt_label(m.group())
                at = m.start() + 1 if seed == "handle" else m.end()  # a handle's second part may begin an address
                if _free(m.start(), m.end(), taken):
                    found.append(self._mail(text, *m.span(), seed, likely))
                    if seed != "handle":
                        taken.append(m.span())
        runs = [m.span() for m in (_DIGITS_ASCII if text.isascii() else _DIGITS).finditer(text)]
        if runs:
            for start, end, kind, seed, likely in self._streets(text, runs):
                if _free(start, end, taken):
                    left = _words_before(text, start)[-2:]
                    form = _FORM.sub("a", _DIGIT.sub("9", text[start:end]))
                    found.append(("address", start, end, text[start:end].lower(), [f"kind {kind}", f"l {' '.join(left)}", f"form {form}"], seed, likely))
                    if seed != "place":
                        taken.append((start, end))
        words = _Words(text)
        kinds = list(map(self.kinds.__getitem__, words.words))
        # a number in words has seven of them at least; beyond ASCII further letters match without regard to case
        may_be_spoken = not text.isascii() or kinds.count(4) + kinds.count(5) + kinds.count(6) >= 7
        spoken = [m.span() for m in _SPOKEN.finditer(text)] if may_be_spoken else []
        for start, end in [*self._numbers(text, runs), *spoken]:
            if _free(start, end, taken):
                found.append(self._number(text, start, end))
                taken.append((start, end))
        found += self._people(text, words, kinds, taken)
        return found

    def _mail(self, text: str, start: int, end: int, seed: str | None, likely: str | None) -> Candidate:
        span = text[start:end].lower()
        sign = _ANY_AT.search(span)
        host = _ANY_DOT.sub(".", span[sign.end() :]) if sign else span
        patterns = [f"l {' '.join(_words_before(text, start)[-2:])}", f"host {host}", f"ends {host.rsplit('.', 1)[-1]}", f"sign {sign.group() if sign else ''}{' dot' if sign and _BARE_DOT.search(span) else ''}"]
        return "handle" if seed == "handle" else "email", start, end, span, patterns, seed, likely

    def _spelt_label(self, spelt: str) -> tuple[str | None, str | None]:
        """A sign in brackets, or apart from its words, is a seed; whether 'word at word.word' is one, patterns tell,
        unless it is a handle or a place for certain."""
        if self._no_address(spelt):
            return "handle", None
        return (None, "email") if _BARE_AT.search(spelt) else ("email", None)

    def _no_address(self, spelt: str) -> bool:
        """Is 'word at word.word' a handle or a place? So it is after an ordinary word, as in 'me at ann.lee', if the
        second part is made of listed names, or if it doesn't end in letters."""
        m = _PLAIN_AT.fullmatch(spelt)
        if not m:
            return False
        parts = m["domain"].lower().split(".")
        return m["local"].lower() in self.ordinary or not parts[-1].isalpha() or all(p in self.names for p in parts)

    def _streets(self, text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str | None, str | None]]:
        """(start, end, kind of street, seed, likely label) at every number that words of an address follow or precede."""
        done = 0
        for at, _ in runs:
            if at < done or at and (text[at - 1].isalnum() or text[at - 1] in ".:/#-,"):
                continue
            start, kind, seed = at, "", None
            m = _AFTER_NO.match(text, at)
            if m:
                kind = (m["kind"] or m["first"]).lower()
                if any(w in self.ordinary for w in map(str.lower, _WORD.findall(m["words"] or ""))):
                    seed = "place"
                elif unit := _UNIT_END.search(text, max(0, at - 25), at):
                    start = unit.start()
            if (not m or seed) and text[max(0, at - 9) : at - 1].lower().endswith(_ENDS):
                name = _NAME_END.search(text, max(0, at - 45), at)
                if name:
                    m, start, seed = _NO_END.match(text, at), name.start(), None
                    kind = next(e for e in _ENDS if name.group()[:-1].lower().endswith(e))
                    if unit := _UNIT_NO_END.search(text, max(0, start - 25), start):
                        start = unit.start()
            if m:
                end, town = m.end(), m["town"]
                if town and town[-1] not in "0123456789" and _WORD.findall(town)[0].lower() in self.not_towns:
                    end -= len(town)
                likely = None if seed else "address"
                yield start, end, kind, seed or ("address" if kind in SEED_STREETS else None), likely
                done = end if not seed else at + 1
            elif open_ := _OPEN_KIND.match(text, at):
                words = open_["words"].lower().split()
                if not any(w.strip("'’-") in self.names or w in self.ordinary for w in words):
                    done = open_.end()
                    yield at, open_.end(), words[-1], None, None

    def _numbers(self, text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Spans of number-like tokens of six or more digits, looked for only where digits are that dense."""
        i = 0
        while i < len(runs):
            j, count = i, runs[i][1] - runs[i][0]
            while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] <= 8:
                j += 1
                count += runs[j][1] - runs[j][0]
            if count >= 6:
                start = runs[i][0]
                while start and text[start - 1] not in " \n\t,;" and runs[i][0] - start < 12:
                    start -= 1
                for m in _NUMBER.finditer(text, max(0, start - 3), min(len(text), runs[j][1] + 12)):
                    if len(_NOT_DIGIT.sub("", m.group())) >= 6 and not _AMOUNT.fullmatch(m.group()):
                        yield m.span()
            i = j + 1

    def _number(self, text: str, start: int, end: int) -> Candidate:
        span, before = text[start:end], _words_before(text, start)
        plain = [w for w in before if w[0].isalpha() and w not in ("no", "number", "nr")]
        shape = _shape(span)
        patterns = [f"shape {shape}", f"l {' '.join(before[-2:])}", f"ls {' '.join(before[-1:])} {shape}"]
        patterns += [f"w {w}" for w in dict.fromkeys(plain[-3:])]
        near = set(plain[-2:])
        seed = None
        if near & set(GOODS_WORDS) or before[-1:] == ["#"]:
            seed = "goods"
        elif near & set(ID_WORDS):
            seed = "id_number"
        elif near & set(PHONE_WORDS) or span.startswith("+"):
            seed = "phone"
        return "number", start, end, _NOT_WORD.sub("", span).lower(), patterns, seed, None

    def _people(self, text: str, at: _Words, kinds: list[int], taken: list[tuple[int, int]]) -> Iterator[Candidate]:
        words = at.words
        count, i, after = len(words), 0, 0
        marks = [False] * count
        marked = []
        for n, kind in enumerate(kinds):
            if kind & 3:
                at.place(n, after)
                after = at.starts[n] + len(words[n])
                if kind & 1 or self._inside(text, at.starts[n], words[n - 1].lower() if n else ""):
                    marks[n] = True
                    marked.append(n)
        for first in marked:
            if first < i or not _free(at.start(first), at.end(first), taken):
                continue
            last = first
            while last + 1 < count:
                gap = text[at.end(last) : at.start(last + 1)]
                nxt = last + 1
                if gap in (" ", "-") and marks[nxt]:
                    last = nxt
                elif gap in (" ", ". ") and len(words[nxt]) == 1 and nxt + 1 < count and (marks[nxt + 1] or at.lower(nxt + 1) in PARTICLES):
                    last = nxt
                elif len(words[last]) == 1 and gap == ". " and marks[nxt]:
                    last = nxt
                elif gap in (" ", ". ") and at.lower(nxt) in PARTICLES and nxt + 1 < count and (marks[nxt + 1] or at.lower(nxt + 1) in PARTICLES):
                    last = nxt
                elif gap == ", " and self._inverted(words[first : last + 1], words[nxt]):
                    last = nxt
                else:
                    break
            while len(words[last]) == 1 or at.lower(last) in PARTICLES:
                last -= 1
            yield self._person(text, at, first, last)
            i = last + 1

    def _inside(self, text: str, start: int, last: str) -> bool:
        """Does a word stand inside a sentence? There an ordinary word with a capital may be a name, too."""
        before = text[max(0, start - 4) : start].rstrip()[-1:]
        return before != "" and (before.isalpha() or before in ",;" or before == ":" and last not in _HEADS) or last in TITLES

    def _inverted(self, family: list[str], given: str) -> bool:
        """Is this 'Family, Given'? The family name may be unlisted, the given name may not."""
        kinds = [self.names.get(w.lower(), "") for w in family]
        if "given" not in self.names.get(given.lower(), "") or any("given" in k and "family" not in k for k in kinds):
            return False
        return "family" in kinds[-1] or family[-1].lower() not in self.ordinary

    def _person(self, text: str, at: _Words, first: int, last: int) -> Candidate:
        words = at.words
        parts = [w.lower().removesuffix("'s").removesuffix("’s") for w in words[first : last + 1]]
        start, back = at.start(first), first
        while back and at.lower(back - 1) in PARTICLES and text[at.end(back - 1) : start] == " ":
            back -= 1
            start = at.start(back)
        while back and len(words[back - 1]) == 1 and text[at.end(back - 1) : start] in (". ", ".") and text[max(0, at.start(back - 1) - 1) : at.start(back - 1)] in ("", " ", "\n", "\t", "\xa0", "(", '"', "<", ":", "."):
            back -= 1
            start = at.start(back)
        if words[first].islower() and back == first and back and text[at.end(back - 1) : start] == " ":
            before = words[back - 1]  # an unlisted given name in lower case
            if before.islower() and len(before) > 2 and before not in self.ordinary:
                back -= 1
                start = at.start(back)
        end, more = at.end(last), last + 1 < len(words)
        own = at.lower(last).endswith(("'s", "’s"))
        left = at.lower(back - 1) if back else "^"
        between = text[(at.end(back - 1) if back else 0) : start]
        gap = between.strip()[-2:]
        after = text[end : at.start(last + 1) if more else len(text)].strip()[:1]
        right = at.lower(last + 1) if more else "$"
        if left not in TITLES and (not back or any(c in ".!?<>\n" for c in between)):
            left, gap, back = "^", "", 0  # a sentence begins: what stands before says nothing
        lr = [_DIGIT.sub("9", f"{left}{gap}"), "'s" if own else f"{after}{right}"]
        before = at.lower(back - 2) if back > 1 else "^"
        patterns = [f"l {lr[0]}", f"r {lr[1]}", f"l2 {before} {lr[0]}", f"lr {lr[0]} {lr[1]}"]
        seed = None
        beyond = at.lower(last + 2) if right == "amp" and last + 2 < len(words) else right
        if not _FIRMS.isdisjoint(parts) or beyond in _FIRMS:
            seed = "firm"
        elif any(p in self.seeds for p in parts):
            seed = "name"
        return "name", start, end - 2 * own, " ".join(parts), patterns, seed, None


def _ordinary_words(texts: DataFrame) -> DataFrame:
    """(word, low, cap, first): uses of a word in lower case, capitalised within and at the start of sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()
        cap: Counter[str] = Counter()
        first: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            low: Counter[str] = Counter()
            for token, n in raw.items():
                if m := alone.fullmatch(token):
                    low[m.group(1)] += n
            keys = list(low.keys() | cap.keys() | first.keys())
            counts = [pa.array([c[k] for k in keys], pa.int64()) for c in (low, cap, first)]
            for c in (raw, cap, first):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *counts], ["word", "low", "cap", "first"])

        # a token between white space is counted as it stands; which of them are words is seen once per distinct one
        alone = re.compile(r"[^\w\s.@+-]*([a-zà-öø-ÿ]{2,}(?:['’][a-z]+)?)[^\w\s@+-]*")
        capital = re.compile(r"[A-ZÀ-Þ](?<=[a-z,;:] .)[a-zà-öø-ÿ]+")
        opening = re.compile(r"(?:^|[.!?>:\n]\s+)([A-ZÀ-Þ][a-zà-öø-ÿ]+)(?=[ ,])")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    raw.update(text.split())
                    cap.update(map(str.lower, capital.findall(text)))
                    first.update(map(str.lower, opening.findall(text)))
            if len(raw) + len(cap) + len(first) > 300_000:
                yield flush()
        yield flush()

    parts = texts.mapInArrow(run, "word string, low bigint, cap bigint, first bigint")
    return parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("low", "cap", "first")))


def _ordinary_set(texts: DataFrame) -> dict[str, bool]:
    """The most frequent words that are mostly written in lower case, or capitalised only where sentences begin; at
    most ``VOCABULARY`` of them, each with whether it is hardly ever capitalised inside a sentence."""
    usual = _ordinary_words(texts).filter("low >= 3 and low > cap or first >= 20 and first > 20 * cap").orderBy(F.expr("low + first").desc(), "word").limit(VOCABULARY)
    return {r.word: r.small for r in usual.select("word", (F.col("cap") * SMALL < F.col("low")).alias("small")).collect()}


def _name_list(names: DataFrame) -> dict[str, str]:
    rows = names.filter("name_part is not null").groupBy(F.lower("name_part").alias("part")).agg(F.concat_ws(" ", F.sort_array(F.collect_set("part_kind"))).alias("kinds"))
    taken = rows.orderBy("part").limit(NAME_LIST + 1).collect()
    if len(taken) > NAME_LIST:
        raise ValueError(f"more than {NAME_LIST} name parts")
    listed: dict[str, str] = {}
    for r in taken:
        last = r.part.split()[-1]  # 'van der X' is found by its last word and the particles before it
        listed[last] = f"{listed.get(last, '')} {r.kinds}".strip()
    return listed


def _candidates(texts: DataFrame, extractor: Extractor) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(extractor)
    kind = dict(texts.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.candidates
        for batch in batches:
            at, group, start, end, instance, patterns, ends, seed, likely = [], [], [], [], [], [], [0], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for g, s, e, x, p, label, other in find(text) if text else ():
                    at.append(i)
                    group.append(g)
                    start.append(s)
                    end.append(e)
                    instance.append(x)
                    patterns += p
                    ends.append(len(patterns))
                    seed.append(label)
                    likely.append(other)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(group, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(instance, pa.string())]
            columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(patterns, pa.string())), pa.array(seed, pa.string()), pa.array(likely, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "group", "start", "end", "instance", "patterns", "seed", "likely"])

    return texts.mapInArrow(run, f"key {kind}, `group` string, start bigint, `end` bigint, instance string, patterns array<string>, seed string, likely string")


def _code(label: Column) -> Column:
    """Labels as numbers, which aggregations hold in place."""
    return F.array_position(F.array(*map(F.lit, LABELS)), label).cast("int")


def _by_pattern(edges: DataFrame, sure: DataFrame) -> DataFrame:
    """Edges with what their sure patterns say. A pattern may be that of a third of all candidates, so the edges of each
    are cut into ``SLICES`` parts, and the sure patterns, which are few beside them, go to every part."""
    each = sure.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return edges.withColumn("slice", F.pmod("id", F.lit(SLICES)).cast("int")).join(each, ["pattern", "slice"])


def _scored(work: Workspace, edges: DataFrame) -> DataFrame:
    """The sure patterns after ``ROUNDS`` of scoring: (pattern, label, score), labels being numbers.

    ``edges`` has a row per pattern of each distinct candidate: (id, instance, seed, name, pattern), where instances and
    patterns are 64-bit hashes. Each round, patterns are scored by the distinct instances of each label, and candidates
    without seed take the label of their surest pattern.
    """
    found = None
    for _ in range(ROUNDS):
        if found is None:
            labelled = edges.withColumn("label", F.col("seed"))
        else:
            labelled = edges.join(found, "id", "left").withColumn("label", F.coalesce("seed", "found"))
        votes = labelled.select("pattern", "name", "instance", "label").distinct().groupBy("pattern", "name", "label").agg(F.count(F.lit(1)).alias("n"))
        known = F.when(F.col("label").isNotNull(), F.col("n"))
        total = votes.groupBy("pattern", "name").agg(
            F.coalesce(F.sum(known), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("open"),
            F.max_by("label", known).alias("label"),
            F.max(known).alias("most"),
        )
        # names: what is capitalised and not yet labelled counts a little against a pattern; the list is far from whole
        against = F.when(F.col("name"), F.col("open") * 0.1).otherwise(F.lit(0.0))
        sure = total.withColumn("score", F.col("most") / (F.col("all") + against + 0.1)).filter((F.col("most") >= SUPPORT) & (F.col("score") >= SURE))
        sure = work.keep(sure.select("pattern", "label", "score"), "sure-patterns")
        found = _by_pattern(edges.filter("seed is null"), sure).groupBy("id").agg(F.max_by("label", "score").alias("found"))
    return sure


def personal_spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Occurrences of personal information: the key columns of ``texts``, pii_kind, start_pos and end_pos.

    ``texts`` has a column ``text`` and any key columns; ``names`` is a list (name_part, part_kind). ``pii_kind`` is
    email, phone, id_number, address or name; ``start_pos`` is the 1-based position of the first character in the text
    as stored and ``end_pos`` that of the last. Null and empty texts have none; repeated rows are each reported; texts
    are read whole; an empty table or name list gives what patterns alone find.
    """
    work = Workspace(texts.sparkSession, "personal-info")
    usual = _ordinary_set(texts.select("text"))
    extractor = Extractor(frozenset(usual), _name_list(names), frozenset(w for w, small in usual.items() if small))
    keys = [c for c in texts.columns if c != "text"]
    keyed = texts.select(F.struct(*keys).alias("key"), "text")
    found = work.keep(_candidates(keyed, extractor), "candidates").withColumn("id", F.xxhash64("group", "instance", "patterns", "seed", "likely"))
    nodes = work.keep(found.select("id", "group", "instance", _code(F.col("seed")).alias("seed"), _code(F.col("likely")).alias("likely"), "patterns").distinct(), "nodes")
    is_name = (F.col("group") == "name").alias("name")
    # handles speak against the patterns of addresses
    shared = F.when(F.col("group") == "handle", "email").otherwise(F.col("group")).alias("group")
    pairs = nodes.select("id", "seed", is_name, shared, F.xxhash64("instance").alias("instance"), F.explode("patterns").alias("p"))
    edges = work.keep(pairs.select("id", "seed", "name", "instance", F.xxhash64("group", "p").alias("pattern"), F.col("p").startswith("r ").alias("right")), "pattern-graph")
    sure = _scored(work, edges)
    # what is no seed needs a pattern that includes the left side: what follows a name may follow any word
    sided = edges.filter("not (name and right)")
    best = _by_pattern(sided, sure).groupBy("id").agg(F.max_by("label", "score").alias("label"))
    judged = nodes.select("group", "id", "instance", "seed", "likely").join(best, "id", "left")
    name, firm, goods, number = (LABELS.index(x) + 1 for x in ("name", "firm", "goods", "id_number"))
    people = judged.filter(F.col("seed") == name).filter("group = 'name'")
    # a listed part that rarely stands where names stand is an ordinary word as well, and needs its context
    part = people.select(F.explode(F.split("instance", " ")).alias("part"), F.col("label").eqNullSafe(name).alias("named"))
    plain = part.groupBy("part").agg(F.avg(F.col("named").cast("int")).alias("share")).filter("share < 0.4").select("part")
    loose = people.filter("instance not like '% %'").join(plain, F.col("instance") == F.col("part"), "left_semi").select("id").withColumn("loose", F.lit(True))
    verdict = judged.join(loose, "id", "left").withColumn(
        "kind",
        F.when(F.col("group") == "number", F.coalesce(F.when(F.col("seed").isin(goods, number), F.col("seed")), "label", "seed"))
        .when(F.col("group").isin("email", "handle", "address"), F.coalesce("seed", "label", "likely"))
        .when(F.col("seed") == firm, F.col("seed"))
        .when((F.col("seed") == name) & F.col("loose").isNull(), F.col("seed"))
        .otherwise(F.col("label")),
    )
    kind = F.element_at(F.array(*map(F.lit, LABELS)), F.col("kind"))
    wanted = verdict.filter("kind is not null").select("id", kind.alias("kind")).filter(F.col("kind").isin(*PLACEHOLDERS))
    # few kinds of candidate are many rows: 'the name after a greeting' may be a third of all
    each = wanted.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    hits = found.select("key", "start", "end", "id").withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(SLICES)).cast("int")).join(each, ["id", "slice"])
    return hits.select("key.*", F.col("kind").alias("pii_kind"), (F.col("start") + 1).alias("start_pos"), F.col("end").alias("end_pos"))


def redacted(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with a column ``redacted``: typed placeholders instead of the spans, the rest unchanged.

    ``spans`` as given by ``personal_spans`` on the same key columns, which must identify a row.
    """
    keys = [c for c in texts.columns if c != "text"]
    span = F.struct("start_pos", "end_pos", "pii_kind")
    per = spans.groupBy(F.struct(*keys).alias("_key")).agg(F.sort_array(F.collect_list(span)).alias("_spans"))
    joined = texts.withColumn("_key", F.struct(*keys)).join(per, "_key", "left")
    marks = F.create_map(*(F.lit(x) for pair in PLACEHOLDERS.items() for x in pair))
    start = F.struct(F.lit("").alias("out"), F.lit(1).cast("bigint").alias("at"))

    def step(state: Column, span: Column) -> Column:
        keep = F.substring(F.col("text"), state["at"].cast("int"), (span["start_pos"] - state["at"]).cast("int"))
        return F.struct(F.concat(state["out"], keep, marks[span["pii_kind"]]).alias("out"), (span["end_pos"] + 1).alias("at"))

    whole = F.aggregate("_spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"].cast("int"), F.length("text"))))
    return joined.select(*keys, "text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(whole).alias("redacted"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [table(spark, sf_dir, t, "row_id", "text").withColumn("table_name", F.lit(t)) for t in ("train", "synthetic_data")]
    return both[0].unionByName(both[1]).select("table_name", "row_id", "text")


def p5_found(spark, sf_dir):
    spans = personal_spans(_texts(spark, sf_dir), table(spark, sf_dir, "name_parts"))
    return spans.select("table_name", "row_id", "pii_kind", "start_pos")


def p5_redacted(spark, sf_dir):
    """The texts of both tables with typed placeholders."""
    texts = _texts(spark, sf_dir)
    return redacted(texts, personal_spans(texts, table(spark, sf_dir, "name_parts"))).select("table_name", "row_id", "redacted")
