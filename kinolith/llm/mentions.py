"""Places in a text that may mention personal data, and what they look like.

``candidates`` proposes spans with the kinds they could be; which of them are mentions is decided
by the model in ``privacy``. All scans are linear in the length of the text: every pattern starts
at a border and has bounded repeats.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

#: Kinds of mentions in the order of their labels; 0 is no mention.
KINDS = ("none", "email", "phone", "id_number", "address", "person")
EMAIL, PHONE, ID, ADDRESS, PERSON = range(1, 6)

_LETTER = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTER}(?:{_LETTER}|[̀-ͯ])*")

_AT = r"(?:\s?@\s?|&#64;|\s?\(at\)\s?|\s?\[at\]\s?)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,62})"
_EMAIL = re.compile(
    rf"(?<![\w.+%-])(?P<local>[a-z0-9][\w.+%-]{{0,63}})(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_DOT}[a-z]{{2,24}}"
    rf"|\sat\s{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}(?:\s?[\[(]dot[\])]\s?|\sdot\s)[a-z]{{2,24}})(?![\w@])",
    re.IGNORECASE,
)

#: Formats of telephone and identity numbers.
NUMBERS = {
    "us": (PHONE, r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}"),
    "uk": (PHONE, r"(?:\+44\s?(?:\(0\)\s?)?|0044\s?(?:\(0\)\s?)?|\(?0)(?:20\)?\s?\d{4}\s?\d{4}|1\d{3}\)?\s?\d{6}|7\d{3}\s?\d{6})"),
    "de": (PHONE, r"(?:(?:\+49|0049)\s?(?:\(0\)\s?)?|0)[1-9]\d{1,3}[\s/-]\s?\d{5,8}(?:[\s-]\d{1,4})?"),
    "fr": (PHONE, r"(?:(?:\+33|0033)\s?(?:\(0\)\s?)?|0)[1-9](?:[\s.-]?\d\d){4}"),
    "es": (PHONE, r"(?:\+34|0034)[\s-]?\d{9}|(?:(?:\+34|0034)[\s-]?)?[5-9]\d{2}(?:(?:[\s-]\d{3}){2}|(?:[\s-]\d\d){3})"),
    "intl": (PHONE, r"\+[1-9]\d{0,2}[\s.-]?(?:\(\d{1,4}\)[\s.-]?)?\d{1,4}(?:[\s.-]?\d{2,8}){1,5}"),
    "ssn": (ID, r"\d{3}-\d{2}-\d{4}|\d{3}\s\d{2}\s\d{4}"),
    "nine": (ID, r"\d{9}"),
    "nino": (ID, r"[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d(?:\s?[A-D])?"),
    "licence": (ID, r"[A-Z]{2}-\d{4}-\d{4}-\d{2}"),
    "passport": (ID, r"[A-Z]{1,3}\d{6,9}"),
    "mixed": (ID, r"\d{2}[A-Z]{2}\d{5}|\d{3}[A-Z]\d{4}|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}"),
    "triples": (ID, r"\d{2}\s\d{3}\s\d{3}\s\d{3}"),
    "nie": (ID, r"[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]"),
    "insee": (ID, r"[12]\s\d\d\s\d\d\s\d\d\s\d{3}\s\d{3}\s\d\d"),
    "long": (ID, r"\d{10,15}"),
}
_NUMBERS = {
    name: (kind, re.compile(rf"(?<![\w/#+-])(?<!\d[.,:])(?:{pattern})(?!\w|[.,:/-]\d)")) for name, (kind, pattern) in NUMBERS.items()
}
#: Where a number of seven digits or of letters and six digits may start.
_START = re.compile(r"(?<![\w/#+-])(?<!\d[.,:])(?=[+(A-Z\d](?:\D{0,3}\d){6})")

_CODE = r"(?:,?\s(?:[A-Z]{2}\s\d{5}|\d{5}|[A-Z]{2}\d\s\d[A-Z]{2})(?!\w))?"
#: Street types of four languages.
STREETS = {
    "en": r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Floor)\s\d{1,4}[A-Za-z]?,\s)?\d{1,5}\s?[A-Za-z]?,?\s(?:[A-Z][\w'’-]{1,30}\s){1,3}"
    r"(?:Street|Road|Avenue|Lane|Terrace|Row|Way|Court|Close|Drive|Square|Place|Crescent|Grove|Gardens|Boulevard|Hill|St|Rd|Ave|Ln|Ct|Dr|Sq|Pl|Blvd)"
    rf"(?!\w)\.?(?:,\s[A-Z][\w-]{{2,30}}(?=[\s,.;|]|$))?{_CODE}",
    "de": r"[A-ZÄÖÜ][\w-]{2,30}(?:straße|strasse|str\.|gasse|allee|weg|platz|ufer|ring|damm|graben|steig)\s\d{1,4}\s?[a-z]?(?!\w)"
    r"(?:,\s\d{5}\s[A-ZÄÖÜ][\w-]+)?",
    "fr": r"\d{1,4}(?:\s(?:bis|ter|quater))?,?\s(?:rue|quai|avenue|boulevard|impasse|allée|place|chemin|av\.|bd)\s"
    r"(?:(?:de\sla|de\sl['’]|des|du|de|d['’])\s?)?[A-ZÉÈÀ][\w'’-]{1,30}(?:\s[A-ZÉÈÀ][\w'’-]{1,30}){0,2}(?:,\s\d{5}\s[A-Z][\w'’-]+)?",
    "es": r"(?:Calle|C/|Plaza|Avda\.|Avenida|Av\.|Paseo|Camino|Ronda|Travesía)\s(?:(?:de\sla|del|de\slos|de)\s)?[A-ZÁÉÍÓÚÑ][\w-]{1,30}"
    r"(?:\s[A-ZÁÉÍÓÚÑ][\w-]{1,30}){0,2},?\s(?:n\.?º\s?)?\d{1,4}(?!\w)(?:,\s\d{1,2}º\s[A-Z](?!\w))?(?:,\s\d{5}\s[A-Z][\w-]+)?",
}
_STREETS = {name: re.compile(rf"(?<![\w/#.,:-])(?:{p})") for name, p in STREETS.items()}

#: Titles before a family name, in lower case.
TITLES = frozenset("mr mrs ms miss dr prof herr frau hr fr m mme mlle sr sra srta dra señor señora monsieur madame".split())

#: Characters that stand for others of the same length.
_SAME = {0x00A0: " ", 0x2007: " ", 0x202F: " ", 0xFF20: "@", 0x2010: "-", 0x2011: "-", 0x2013: "-", 0x2019: "'"}


def fold(text: str) -> str:
    """The text with spaces, hyphens and at signs of other forms made plain; no offset moves."""
    return text.translate(_SAME)


_BLANKS = re.compile(r"\s{2,}")


def squeeze(text: str) -> tuple[str, list[int] | None]:
    """The text with runs of blanks made one, but for empty lines, and each character's place before.

    The places are None where nothing changed.
    """
    out, places, last = [], [], 0
    for m in _BLANKS.finditer(text):
        run = m.group()
        if run.count("\n") > 1 or run.count("\r") > 1:
            continue
        out += [text[last : m.start()], "\n" if "\n" in run else " "]
        places += [*range(last, m.start()), m.start()]
        last = m.end()
    if not out:
        return text, None
    return "".join([*out, text[last:]]), [*places, *range(last, len(text))]


def plain(word: str) -> str:
    """A word without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).casefold()


class Lexicon:
    """Listed names, and the beginnings and ends that several of them share."""

    def __init__(self, given: list[str], family: list[str]) -> None:
        self.given, self.family = frozenset(map(plain, given)), frozenset(map(plain, family))
        self.given_ends, self.family_ends = self._ends(self.given), self._ends(self.family)
        self.seen: dict[str, int] = {}

    @staticmethod
    def _ends(names: frozenset) -> tuple[frozenset, frozenset]:
        heads: dict[str, set] = {}
        tails: dict[str, set] = {}
        for name in names:
            for i in range(2, len(name) - 1):
                heads.setdefault(name[:i], set()).add(name[i:])
                tails.setdefault(name[i:], set()).add(name[:i])
        return frozenset(h for h, t in heads.items() if len(t) > 2), frozenset(t for t, h in tails.items() if len(h) > 2)

    def flags(self, word: str) -> int:
        """Bits: 1 listed given name, 2 listed family name, 4 made like given ones, 8 like family ones, 16 title."""
        f = self.seen.get(word)
        if f is None:
            w = plain(word)
            like = lambda ends: any(w[:i] in ends[0] and w[i:] in ends[1] for i in range(2, len(w) - 1))
            f = (w in self.given) | (w in self.family) << 1 | like(self.given_ends) << 2
            f |= (len(w) > 5 and like(self.family_ends)) << 3 | (word.casefold() in TITLES) << 4
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = f
        return f


@dataclass(slots=True)
class Candidate:
    """A span with the kinds it may be, its features and its keys for skip edges."""

    start: int
    end: int
    kinds: set
    marks: list = field(default_factory=list)
    keys: list = field(default_factory=list)


def _around(text: str, start: int, end: int) -> list[str]:
    """Features of the two words before and the one after a span."""
    before = [w.lower() for w in re.findall(r"[^\W\d_]+|[^\w\s]|\d+", text[max(0, start - 40) : start])[-3:]]
    before = ["9" * min(len(w), 4) if w.isdigit() else w for w in before]
    after = re.findall(r"[^\W\d_]+|[^\w\s]|\d+", text[end : end + 20])[:1]
    words = [w for w in before if w[0].isalpha()]
    out = [f"b1={before[-1] if before else '^'}", f"a1={after[0].lower() if after and not after[0].isdigit() else bool(after)}"]
    out += [f"w={w}" for w in words]
    out.append("bb=" + " ".join(before[-2:]))
    return out


def _given(flags: int) -> str:
    return "listed" if flags & 1 else "like" if flags & 4 else "other"


def _persons(text: str, lexicon: Lexicon, taken: list[tuple[int, int]]) -> list[Candidate]:
    found, last_end, ends = [], 0, iter([*taken, (len(text) + 1, len(text) + 1)])
    skip = next(ends)
    words: list[tuple[int, int, int]] = []  # the words so far: start, end, flags
    for m in _WORD.finditer(text):
        s, e = m.span()
        while s >= skip[1]:
            skip = next(ends)
        if s >= skip[0]:
            words.append((s, e, 0))
            continue
        words.append((s, e, lexicon.flags(m.group())))
        if len(words) > 64:
            del words[:32]
        f = words[-1][2]
        prior = words[-2] if len(words) > 1 else None
        if prior is None:
            continue
        gap = text[prior[1] : s]
        span, marks = None, []
        upper = text[s].isupper()
        named = text[prior[0]].isupper() and prior[1] - prior[0] > 2 and not prior[2] & 16
        if f & 10 or (upper and e - s > 2 and (prior[2] & 1 or prior[2] & 16 and not f & 5)):
            fam = "listed" if f & 2 else "like" if f & 8 else "other"
            if gap.isspace() and len(gap) <= 3 and prior[0] >= last_end and not prior[2] & 16 and (prior[2] & 5 or named):
                span, marks = prior[0], [f"order=GF {_given(prior[2])} {fam}"]
            elif re.fullmatch(r"\.?\s{1,3}", gap) and prior[2] & 16 and text[prior[0]].isupper():
                # a family name behind it makes an unknown word a given name
                behind = _WORD.match(text, e + 1) if fam == "other" and text[e : e + 1].isspace() else None
                if not (behind and lexicon.flags(behind.group()) & 10):
                    span, marks = s, [f"order=TF {fam}"]
            elif re.fullmatch(r"\.\s{0,3}", gap) and prior[1] - prior[0] == 1 and text[prior[0]].isupper():
                span, marks = prior[0], [f"order=IF {fam}"]
                if len(words) > 2 and words[-3][0] >= last_end and text[words[-3][1] : prior[0]].isspace() and not words[-3][2] & 16:
                    if words[-3][2] & 5 or text[words[-3][0]].isupper():
                        span, marks = words[-3][0], [f"order=GIF {_given(words[-3][2])} {fam}"]
        second = f & 5 or (upper and e - s > 2 and not f & 16)
        if span is None and second and prior[2] & 10 and prior[0] >= last_end and re.fullmatch(r",?\s{1,3}", gap) and ("," in gap or f & 1):
            order = "F,G" if "," in gap else "FG"
            span, marks = prior[0], [f"order={order} {'listed' if prior[2] & 2 else 'like'} {_given(f)}"]
        if span is None or span < last_end:
            continue
        name = text[span:e]
        case = "upper" if name.isupper() else "lower" if name.islower() else "title" if upper else "mixed"
        tail = plain(text[s:e])
        marks += [f"case={case}", f"tail={tail[-4:]}", f"head={tail[:4]}"]
        found.append(Candidate(span, e, {PERSON}, marks, ["p " + tail, "q " + plain(name)]))
        last_end = e
    return found


def candidates(text: str, lexicon: Lexicon) -> list[Candidate]:
    """Candidates of a folded text by place; they don't overlap."""
    text, places = squeeze(text)
    found = _candidates(text, lexicon)
    if places is not None:
        for c in found:
            c.start, c.end = places[c.start], places[c.end - 1] + 1
    return found


def _candidates(text: str, lexicon: Lexicon) -> list[Candidate]:
    found: list[Candidate] = []
    if "@" in text or "&#64;" in text or "(at" in text.lower() or "[at" in text.lower() or "dot" in text.lower():
        for m in _EMAIL.finditer(text):
            ending = re.split(r"[^a-z]+", m.group().lower())[-1]
            found.append(Candidate(*m.span(), {EMAIL}, ["email", f"ending={ending}"], ["e " + m["local"].lower()]))
    for name, pattern in _STREETS.items():
        for m in pattern.finditer(text):
            found.append(Candidate(*m.span(), {ADDRESS}, [f"street={name}"], ["a " + plain(m.group()[:24])]))
    spans: dict[tuple[int, int], Candidate] = {}
    for place in _START.finditer(text):
        for name, (kind, pattern) in _NUMBERS.items():
            m = pattern.match(text, place.start())
            if not m:
                continue
            c = spans.setdefault(m.span(), Candidate(*m.span(), set()))
            c.kinds.add(kind)
            c.marks.append(f"format={name}")
    for c in spans.values():
        raw = text[c.start : c.end]
        shape = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", raw))
        c.marks += [f"shape={shape}", f"plus={raw[0] == '+'}", "formats=" + "+".join(x[7:] for x in c.marks)]
        c.keys = ["n " + re.sub(r"\W", "", raw), "f " + shape]
    # of overlapping ones the longer stays, then the earlier
    kept: list[Candidate] = []
    for c in sorted([*found, *spans.values()], key=lambda c: (c.start, -c.end)):
        if kept and c.start < kept[-1].end:
            if c.end - c.start > kept[-1].end - kept[-1].start and EMAIL not in kept[-1].kinds:
                kept[-1] = c
            continue
        kept.append(c)
    kept += _persons(text, lexicon, [(c.start, c.end) for c in kept])
    kept.sort(key=lambda c: c.start)
    for c in kept:
        c.marks += _around(text, c.start, c.end)
    return kept
