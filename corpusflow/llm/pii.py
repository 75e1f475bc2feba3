"""Offset-preserving deobfuscation and detection of personal identifiers.

Transducers rewrite a text step by step and keep, for each character of the result,
the span of source characters that it came from:

1. homoglyphs: full-width forms, Cyrillic and Greek look-alikes of Latin letters,
   other scripts' digits and look-alike punctuation, one character for one; invisible
   characters (zero-width, soft hyphen, direction marks) are erased
2. spelled digits: runs of at least 3 digit words of English, German, French or Spanish (``oh`` within a
   run is 0), joined by spaces, hyphens, dots or commas, or by ``plus`` at their start
3. at and dot: ``[at] (at) {at} <at>`` and ``[dot] (dot) ...`` anywhere, the bare words ``at`` and ``dot``
   only in ``name at host dot domain``; spaces around them go; likewise ``ät`` and ``punkt``, ``arobase`` and
   ``point``, ``arroba`` and ``punto``

Detectors then run on the normalised text: e-mail addresses (a local part of at most 64
characters, as mail allows), card numbers (13 to 19 digits, Luhn: solid; 4-4-4-4 with
up to 3 more; 4-6-5; or groups of 3 to 10, then 2 to 10 digits, up to 5 in all, that
stand alone, of a first digit from 2 to 6; one kind of separator, a space or a hyphen),
IPv4 addresses, US social security numbers, IBANs (mod 97) and
telephone numbers, in this order; a span belongs to the first that takes it.  Digits of
a spelled run need no separators: 9 of them may be a social security number, 7 to 15 a
telephone number.  Each
normalised span is mapped back to the source characters (start inclusive, end
exclusive, code points), so ``surface`` is exactly what stands in the source.

A JVM expression that is a necessary condition for a detection keeps texts
without any trace from Python; the rest is processed whole, text by text, in time
linear in its length (the tests run it on a megabyte of spaces, digits, dots, at signs
and words that never end a match).

* null or empty text: no findings; null doc_id: its findings have doc_id null
* very long text: processed whole, as any other; empty table: empty result
* repeated rows: each has its findings; extra columns: not in the result
* ties: of detectors that want the same span the one named first; of one detector the match that begins first
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm._common import picked

_LOOK = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲνⅼ", "ABEKMHOPCTXaeopcyxijsdhqwABEZHIKMNOPTYXocvl"))
_LOOK |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {"﹫": "@", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "　": " ", " ": " ", " ": " ", " ": " "}
_LOOK |= {c: str(unicodedata.decimal(c)) for c in map(chr, range(0x80, 0x1FBFA)) if unicodedata.category(c) == "Nd"}
_GONE = "​‌‍⁠﻿­‎‏‪‫‬‭‮"
TABLE = str.maketrans(_LOOK)
_ERASE = re.compile(f"[{_GONE}]+")

_DIGIT = {"oh": "0"} | {w: str(k) for k, words in enumerate((
    "zero null zéro ze\u0301ro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf fu\u0308nf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)) for w in words.split()}
_DW = f"(?:{'|'.join(sorted(_DIGIT.keys() - {'oh'}, key=lambda w: (-len(w), w)))})"
_PLUS = "(?:plus|más|mas)"
_SPELLED = re.compile(rf"(?i)\b(?!un[ \-.,]+[0-9])(?:{_PLUS}[ ]+)?{_DW}(?:[ \-.,]{{1,3}}(?:{_DW}|oh|[0-9]+)){{2,}}\b")
_PART = re.compile(rf"(?i){_PLUS}[ ]+|{_DW}|oh|[0-9]+|[ \-.,]+")
#: words for at and for dot, by language
_WORDS = (("at|ät|a\u0308t", "dot|punkt"), ("arobase|arobas", "point|dot"), ("arroba", "punto|dot"))
_AT, _DOT = ("|".join(sorted({w for pair in _WORDS for w in pair[k].split("|")}, reverse=True)) for k in (0, 1))
#: in brackets; the spaces around a match are added to it afterwards, which keeps the search linear
_ATDOT = re.compile(rf"(?i)[\[({{<][ ]*(?:(?P<at>{_AT})|(?P<dot>{_DOT}))[ ]*[\])}}>]")
#: (what a text needs, at words, dot words) of each language, for ``name at host dot domain``
_PLAIN_ATDOT = [(re.compile(rf"(?i) (?:{at}) "), re.compile(rf"(?i) (?:{dot}) "), frozenset(at.split("|")), frozenset(dot.split("|"))) for at, dot in _WORDS]
_TOKEN = re.compile("[^ ]+")
_LOCAL, _LABEL = re.compile(r"(?i)(?:^|[\s,;:<(])([a-z0-9][a-z0-9._%+-]*)$"), re.compile("(?i)[a-z0-9]+")
_HOST, _TOP = re.compile(r"(?i)[a-z0-9-]+(?:\.[a-z0-9-]+)*"), re.compile(r"(?i)[a-z]{2,}\b")
#: not a host by themselves if one dot follows: ``at the dot com``
_ARTICLES = frozenset("the a an this that my our your".split())

def _class(chars: Iterable[str]) -> str:
    """A class of regular expressions, of ranges."""
    codes, out = sorted(set(map(ord, chars))), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


#: what such a character hides is known only when it is rewritten (long s and the Turkish i are equal to s and i for Python, where case is ignored)
_DISGUISE = _class([*_LOOK, *_GONE, "\u0130", "\u0131", "\u017f"])
_BEYOND = r"[\x{A0}\x{AD}\x{100}-\x{10FFFF}]"
#: 7 digits close together, four numbers with dots, or the head of an IBAN
_NUMBERS = r"[0-9](?:(?:[ .()+-]{0,4}[0-9]){6}|[0-9]{0,2}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9])|[A-Z][A-Z][0-9][0-9]"


def _trie(words: Iterable[str]) -> str:
    """A regular expression of the words, with shared prefixes factored out."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        parts = [c + build(child) for c, child in sorted(node.items()) if c]
        body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
        return f"(?:{body})?" if parts and "" in node else body

    return build(root)


_SOME, _ANY = _trie(_DIGIT.keys() - {"oh"}), _trie(_DIGIT)
#: in lower case: a word in brackets; three spelled digits in a row, or a dot word
_BRACKETED = rf"[\[({{<] *(?:{_AT}|{_DOT}) *[\])}}>]"
_HEADS = "".join(sorted({w[0] for w in [*_DIGIT, "dot", "punkt", "arroba"]}))
_SPELLED_OUT = rf"(?<![a-z0-9_])(?=[{_HEADS}])(?:{_SOME}[ .,-]{{1,3}}(?:{_ANY}|[0-9]{{1,40}})[ .,-]{{1,3}}(?:{_ANY}|[0-9])|dot |punkt |arrobas? |arobase? |arobas )"


class Mapped:
    """A text and where its characters came from: runs of (start, source start); after a rewritten piece a new run starts.  A rewritten piece as a whole comes from one source span."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.source, self.ends = text, [0], [0], [len(text)]
        self.exact = [True]
        self.spelled: list[tuple[int, int]] = []

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Source span of characters start..end (not empty)."""
        return self._at(start)[0], self._at(end - 1)[1]

    def _at(self, k: int) -> tuple[int, int]:
        r = bisect_right(self.starts, k) - 1
        if self.exact[r]:
            at = self.source[r] + k - self.starts[r]
            return at, at + 1
        return self.source[r], self.ends[r]

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> Mapped:
        """The text with the pieces (start, end, new; in order, apart) replaced."""
        if not pieces:
            return self
        out = Mapped("")
        out.spelled = self.spelled
        out.starts, out.source, out.ends, out.exact = [], [], [], []
        parts: list[str] = []
        length = 0

        def keep(s: int, e: int) -> None:
            nonlocal length
            while s < e:
                r = bisect_right(self.starts, s) - 1
                stop = min(e, self.starts[r + 1]) if r + 1 < len(self.starts) else e
                out.starts.append(length)
                out.exact.append(self.exact[r])
                out.source.append(self.source[r] + s - self.starts[r] if self.exact[r] else self.source[r])
                out.ends.append(self.ends[r])
                parts.append(self.text[s:stop])
                length += stop - s
                s = stop

        at = 0
        for s, e, new in pieces:
            keep(at, s)
            if new:
                a, b = self.span(s, e)
                out.starts.append(length)
                out.source.append(a)
                out.ends.append(b)
                out.exact.append(False)
                parts.append(new)
                length += len(new)
            at = e
        keep(at, len(self.text))
        out.text = "".join(parts)
        return out


def _digits_of(piece: str, start: int) -> list[tuple[int, int, str]]:
    """Spelled digits one by one, so each digit maps to its own word.  Separators go, but where they differ within the run, dots stay and commas and hyphens become hyphens."""
    found = [(m.start() + start, m.end() + start, m.group().lower()) for m in _PART.finditer(piece)]
    marks = {x.strip() for _, _, x in found if not x[0].isalnum()}
    out = []
    for s, e, x in found:
        if x[0].isalnum():
            new = "+" if x[-1] == " " else _DIGIT.get(x, x)
        else:
            new = "" if len(marks) == 1 or not x.strip() else "." if x.strip() == "." else "-"
        out.append((s, e, new))
    return out


def normalise(text: str) -> Mapped:
    m = Mapped(text)
    if not text.isascii():
        m.text = text.translate(TABLE)  # one for one
        m = m.rewrite([(x.start(), x.end(), "") for x in _ERASE.finditer(m.text)])
    runs = list(_SPELLED.finditer(m.text))
    m.spelled = [m.span(*x.span()) for x in runs]
    m = m.rewrite([p for x in runs for p in _digits_of(x.group(), x.start())])
    m = m.rewrite(_bracketed(m.text))
    for at, dot, at_words, dot_words in _PLAIN_ATDOT:
        if dot.search(m.text) and at.search(m.text):
            m = m.rewrite(_plain(m.text, at_words, dot_words))
    return m


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    last = 0
    for x in _ATDOT.finditer(text):
        s, e = x.span()
        while s > last and text[s - 1] == " ":
            s -= 1
        while e < len(text) and text[e] == " ":
            e += 1
        out.append((max(s, last), e, "@" if x.lastgroup == "at" else "."))
        last = e
    return out


def _plain(text: str, at_words: frozenset[str], dot_words: frozenset[str]) -> list[tuple[int, int, str]]:
    """``name (dot name)* at host (dot host)* dot domain`` of words between spaces: from each at word one walk to the left and one to the right, so in linear time."""
    tokens = [(x.start(), x.end()) for x in _TOKEN.finditer(text)]
    word = [text[s:e].lower() if e - s <= 8 else "" for s, e in tokens]
    out: list[tuple[int, int, str]] = []
    free = 0  # the first token that no match has taken
    for i in [i for i, w in enumerate(word) if w in at_words]:
        if i - 1 < free or i + 3 >= len(tokens):
            continue
        first = i - 1
        local = _LOCAL.search(text[slice(*tokens[first])])
        if local is None:
            continue
        while first - 2 >= free and word[first - 1] in dot_words and _LABEL.fullmatch(text[slice(*tokens[first])]) and _LOCAL.search(text[slice(*tokens[first - 2])]):
            first -= 2
        k, last = i + 1, None
        while k + 2 < len(tokens) and word[k + 1] in dot_words and _HOST.fullmatch(text[slice(*tokens[k])]):
            if _TOP.match(text[slice(*tokens[k + 2])]):
                last = k + 2
            k += 2
        if last is None or (last == i + 3 and word[i + 1] in _ARTICLES):
            continue
        out += [(tokens[j - 1][1], tokens[j + 1][0], ".") for j in range(first + 1, i, 2)]
        out.append((tokens[i - 1][1], tokens[i + 1][0], "@"))
        out += [(tokens[j - 1][1], tokens[j + 1][0], ".") for j in range(i + 2, last, 2)]
        free = last + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _card(s: str) -> bool:
    d = re.sub("[ -]", "", s)
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d)


def _grouped_card(s: str) -> bool:
    return "2" <= s[0] <= "6" and _card(s)


def _phone(s: str) -> bool:
    n = sum(c.isdigit() for c in s)
    return 7 <= n <= 15 and (s[0] == "+" or "(" in s or re.search(r"\d[ .-]\d", s) is not None or n == 10)


def _spelled_ssn(s: str) -> bool:
    return _SSN.fullmatch(s) is not None and _spelled_phone(s)


def _spelled_phone(s: str) -> bool:
    return len(set(s)) > 1  # not one word over and over


_SSN = re.compile("(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}")
#: (pattern, what else a detector takes) of digits that come from a run of spelled ones
SPELLED = {
    "ssn": (re.compile("(?<![0-9A-Za-z.+-])[0-9]{9}(?![0-9A-Za-z-]|\\.[0-9])"), _spelled_ssn),
    "phone": (re.compile("(?<![0-9A-Za-z.+])[0-9]{7,15}(?![0-9A-Za-z]|\\.[0-9])"), _spelled_phone),
}
DETECTORS = (
    ("email", re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63}@(?:[a-z0-9-]{1,63}\.)+[a-z]{2,24}(?![a-z0-9-])"), None),
    ("card", re.compile(r"(?<![0-9.])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"), _card),
    ("card", re.compile(r"(?<![0-9.])(?<![0-9][ -])[0-9]{3,10}([ -])[0-9]{2,10}(?:\1[0-9]{2,10}){0,3}(?![0-9]|[ -][0-9])"), _grouped_card),
    ("ipv4", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"), None),
    ("ssn", re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), None),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Z0-9])"), _iban),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z]|\.[0-9])"), _phone),
)


class _Spans:
    """Spans that don't overlap, in order."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a

    def contains(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and self.ends[k] >= b

    def update(self, spans: list[tuple[int, int]]) -> None:
        both = sorted([*zip(self.starts, self.ends), *spans])
        self.starts, self.ends = [a for a, _ in both], [b for _, b in both]


def findings(text: str) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, surface, normalised) in the order of the source."""
    m = normalise(text)
    taken, spelled_runs = _Spans(), _Spans(m.spelled)
    out = []

    def take(kind: str, pattern: re.Pattern, valid, spelled: bool = False) -> None:
        new = []  # matches of one pattern don't overlap
        for x in pattern.finditer(m.text):
            s, e = x.span()
            if (valid is None or valid(x.group())) and not taken.overlaps(s, e):
                a, b = m.span(s, e)
                if spelled and not spelled_runs.contains(a, b):
                    continue
                new.append((s, e))
                out.append((kind, a, b, text[a:b], x.group()))
        taken.update(new)

    for kind, pattern, valid in DETECTORS:
        if kind == "email" and "@" not in m.text:
            continue
        take(kind, pattern, valid)
        if m.spelled and kind in SPELLED:
            take(kind, *SPELLED[kind], spelled=True)
    return sorted(out, key=lambda f: (f[1], f[2], f[0]))


_SCHEMA = "doc_id bigint, kind string, start int, end int, surface string, normalized string"


def has_trace(text: Column) -> Column:
    """A necessary condition for a finding.  The tests are cheap ones first, without unbounded groups; the class of disguises is only asked where a character is beyond Latin-1."""
    low = F.lower(text)
    disguised = (F.octet_length(text) != F.length(text)) & text.rlike(_BEYOND) & text.rlike(_DISGUISE)
    return text.contains("@") | disguised | text.rlike(_NUMBERS) | low.rlike(_BRACKETED) | low.rlike(_SPELLED_OUT)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, surface and normalized, a row for each identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *f) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for f in findings(t.as_py())]
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "kind", "start", "end", "surface", "normalized"])

    source = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return source.filter(has_trace(F.col("text"))).mapInArrow(run, _SCHEMA)
