"""Operator 10: personal data, also where it is disguised.

Base rules find e-mail addresses, IP addresses, card and phone numbers as they stand. A
chain of transducers then rewrites the text: look-alike letters and digits of other
scripts, spelled digits, and at and dot in words or brackets. Every character of its
output keeps the span of the source that it came from, so that what the same rules find
there maps back to the source. Base spans stay; a found span is added where it overlaps
none of its kind, or is wider than all that it overlaps (of a name with one foreign letter the base rules see a part).

Every rule takes time in proportion to the text, also on long runs of letters or digits.

What counts as one disguise has limits, which are parameters below: white space and separators inside it (GAP), a host's
label (LABEL, as in domain names), and a number with letters for digits (MIXED). A run of spelled digits has none.

Defined cases: a null or empty text has no spans, a very long one is searched whole; repeated rows are searched each;
offsets are code points of the source, with the end exclusive; of spans found that overlap only the first is added;
other columns of the table are not read by ``detect`` and kept by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from rxflow.llm.common import hold, map_arrow, table, texts, tune

KINDS = ("email", "ip", "card", "phone")
#: Characters of white space or separators inside a disguise, of a label of a host, and between the ends of a mixed number, at most.
GAP, LABEL, MIXED = 3, 63, 40
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, one @ after the other: what stands before it is taken back to the match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:  # no later match can begin before this @
            done = at + 1
            at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    """What the base rules find, kind by kind."""
    out = _emails(text) if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# Letters of other scripts that look like ASCII ones, in pairs.
_ALIKE = dict(
    zip(
        "АВЕКМНОРСТХУЅІЈаеорсухѕіјԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρι",
        "ABEKMHOPCTXYSIJaeopcyxsijdqwhABEZHIKMNOPTYXoavpi",
    )
)
# The digits from 0 to 9 in words.
_SPELLED = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0"}
# At and dot in words, in pairs of a language; and ends of hosts, of country codes those that are no English word.
_PAIRS = (("at", "dot|punkt"), ("arobase", "point"), ("arroba", "punto"))
_ENDS = (
    "com org net edu gov mil int info biz name pro dev app tech blog shop online site cloud xyz "
    "ae ag ai al ar au az ba bd bg bo br by bz ca cc ch ci cl cm cn co cr cu cy cz de dk dz ec ee eg es eu fi fm fr ge gh gr gt hk hn hr hu id ie il "
    "io iq ir jo jp ke kr kw kz la lb lk lt lu lv ly ma md mk mn mt mu mx mz ng ni nl np nz om pa pe ph pk pl pr pt py qa ro rs ru rw sa se sg si sk sn "
    "sv sy th tn tr tv tw tz ua ug uk uy uz ve vn ye za zw"
).replace(" ", "|")
_AT = "|".join(at for at, _ in _PAIRS)
_DOT = "|".join(dot for _, dot in _PAIRS)


@lru_cache(maxsize=65536)
def _plain(c: str) -> str:
    """The ASCII character that one of another script stands for; nothing for one without width."""
    if c in _ALIKE:
        return _ALIKE[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Pd":
        return "-"
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    flat = unicodedata.normalize("NFKC", c)
    return flat if len(flat) == 1 and flat.isascii() else c


_FOREIGN = re.compile(r"[^\x00-\xac\xae-˿]")
_LEFT, _RIGHT = rf"\s{{0,{GAP}}}[\[({{<]\s{{0,{GAP}}}", rf"\s{{0,{GAP}}}[\])}}>]\s{{0,{GAP}}}"
_SIGN_AT = re.compile(rf"{_LEFT}(?:{_AT}|@){_RIGHT}", re.I)
_SIGN_DOT = re.compile(rf"{_LEFT}(?:{_DOT}|\.){_RIGHT}", re.I)


#: Words that follow "at" in sentences; no host starts with one.
_NO_HOST = "a|all|an|any|each|every|first|her|his|home|it|its|last|least|most|my|no|night|noon|once|one|our|some|that|the|their|these|this|those|work|your"


def _point(dot: str) -> str:
    """A dot in words or brackets."""
    return rf"(?:\s{{1,{GAP}}}(?:{dot})\s{{1,{GAP}}}|{_LEFT}(?:{dot}|\.){_RIGHT})"


def _in_words(at: str, dot: str) -> str:
    """An address in words before its host: name at host dot com. The dots are written or bracketed, for a plain host after
    "at" is prose; and the host has a known end."""
    label, point = rf"[A-Za-z0-9-]{{1,{LABEL}}}", _point(dot)
    return rf"(?<=[A-Za-z0-9])\s{{1,{GAP}}}(?:{at})\s{{1,{GAP}}}(?!(?:{_NO_HOST})\s)(?={label}(?:{point}{label}){{0,3}}?{point}(?:{_ENDS})(?![A-Za-z0-9-]))"


_IN_WORDS = re.compile("|".join([*(_in_words(*pair) for pair in _PAIRS), rf"(?<=[A-Za-z0-9])@(?=[A-Za-z0-9-]{{1,{LABEL}}}\s{{1,{GAP}}}(?:{_DOT})\s)"]), re.I)
#: Four numbers with dots in words, as in an IP address.
_IP_WORDS = re.compile(rf"(?<![A-Za-z0-9.])[0-9]{{1,3}}(?:\s{{1,{GAP}}}(?:{_DOT})\s{{1,{GAP}}}[0-9]{{1,3}}){{3}}(?![A-Za-z0-9])", re.I)
_IP_HINT = re.compile(rf"[0-9]\s{{1,{GAP}}}(?:{_DOT})\s{{1,{GAP}}}[0-9]", re.I)
_DOT_WORD = re.compile(rf"\s{{1,{GAP}}}(?:{_DOT})\s{{1,{GAP}}}(?=[A-Za-z0-9-])", re.I)
_POINT = re.compile(rf"{_point(_DOT)}(?=[A-Za-z0-9-])", re.I)
_PART = re.compile(rf"[A-Za-z0-9-]{{1,{LABEL}}}")
_NAMES = "|".join(sorted(_SPELLED, key=len, reverse=True))
_TOKEN = rf"(?:{_NAMES}|plus|{_DOT}|[+0-9](?![A-Za-z0-9]))"
#: At least four spelled or single digits in a row, with their separators.
_IN_DIGITS = re.compile(rf"(?<![^\W_])(?:{_TOKEN}[\s,-]{{1,{GAP}}}){{3,}}{_TOKEN}(?![^\W_])", re.I)
_ONE = re.compile(rf"{_TOKEN}", re.I)
#: Letters for digits inside a number: O and l.
_MIXED = re.compile(rf"(?<![A-Za-z0-9])(?=[OoIl().\x20-]{{0,8}}[0-9])[0-9OoIl+][0-9OoIl().\x20-]{{5,{MIXED}}}[0-9OoIl](?![A-Za-z0-9])")
_HINT = re.compile(rf"[\[({{<]\s{{0,{GAP}}}(?:{_AT}|{_DOT}|@|\.)\s{{0,{GAP}}}[\])}}>]|\b(?:{_AT})\s.{{1,70}}\b(?:{_DOT})\b|@\S{{1,{LABEL}}}\s{{1,{GAP}}}(?:{_DOT})\b", re.I)
_SPELLED_HINT = re.compile(rf"\b(?:{_NAMES})[\s,-]{{1,{GAP}}}(?:{_NAMES})\b", re.I)
_MIXED_HINT = re.compile(r"[0-9][OoIl][0-9OoIl().\x20-]|[0-9.-][OoIl][0-9]")


class Tape:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | None = None  # None: each character is its own
        self.ends: list[int] | None = None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, in order. A character of a replacement stands for the whole span that it replaces,
        unless it replaces as many characters, which it stands for one by one."""
        if not edits:
            return
        starts = self.starts if self.starts is not None else list(range(len(self.text)))
        ends = self.ends if self.ends is not None else list(range(1, len(self.text) + 1))
        parts, new_starts, new_ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += (self.text[at:a], new)
            new_starts += starts[at:a]
            new_ends += ends[at:a]
            if len(new) == b - a:
                new_starts += starts[a:b]
                new_ends += ends[a:b]
            else:
                new_starts += [starts[a]] * len(new)
                new_ends += [ends[b - 1]] * len(new)
            at = b
        parts.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(parts), new_starts + starts[at:], new_ends + ends[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (self.starts[a], self.ends[b - 1]) if self.starts is not None else (a, b)


def _number(tape: Tape) -> None:
    """Spelled digits: each word of a run becomes its digit, and what separates them goes."""
    edits = []
    for m in _IN_DIGITS.finditer(tape.text):
        tokens = list(_ONE.finditer(tape.text, *m.span()))
        if sum(t[0].lower() in _SPELLED for t in tokens) < 4:
            continue
        for k, t in enumerate(tokens):
            word = t[0].lower()
            new = _SPELLED.get(word) or {"plus": "+"}.get(word) or ("." if re.fullmatch(_DOT, word) else word)
            if k:
                edits.append((tokens[k - 1].end(), t.start(), ""))
            edits.append((*t.span(), new))
    tape.rewrite(edits)


def normalised(text: str) -> Tape:
    """The text without its disguises."""
    tape = Tape(text)
    if _FOREIGN.search(text):
        tape.rewrite([(m.start(), m.end(), p) for m in _FOREIGN.finditer(text) if (p := _plain(m[0])) != m[0]])
    if _SPELLED_HINT.search(tape.text):
        _number(tape)
    if _IP_HINT.search(tape.text):
        tape.rewrite([(*d.span(), ".") for m in _IP_WORDS.finditer(tape.text) for d in _DOT_WORD.finditer(tape.text, *m.span())])
    if _HINT.search(tape.text):
        tape.rewrite([(*m.span(), "@") for m in _SIGN_AT.finditer(tape.text)])
        tape.rewrite([(*m.span(), "@") for m in _IN_WORDS.finditer(tape.text)])
        edits = []
        for m in re.finditer("@", tape.text):  # dots in words or brackets of the host after an @
            at = m.end()
            while (part := _PART.match(tape.text, at)) and (dot := _POINT.match(tape.text, part.end())):
                edits.append((*dot.span(), "."))
                at = dot.end()
        tape.rewrite(edits)
        tape.rewrite([(*m.span(), ".") for m in _SIGN_DOT.finditer(tape.text)])
    if _MIXED_HINT.search(tape.text):
        edits = []
        for m in _MIXED.finditer(tape.text):
            if sum(c.isdigit() for c in m[0]) >= 5:
                new = m[0].translate(str.maketrans("OoIl", "0011"))
                edits.append((*m.span(), new)) if new != m[0] else None
        tape.rewrite(edits)
    return tape


def _meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the ordered spans overlaps this one."""
    k = bisect_left(spans, (b, 0))
    return k > 0 and spans[k - 1][1] > a


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start and then by kind."""
    hold("personal", _plain.cache_clear)
    base = base_spans(text)
    tape = normalised(text)
    every = list(base)
    if tape.starts is not None:
        held: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        for kind, a, b in base:
            held[kind].append((a, b))
        done, last = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
        for kind, a, b in base_spans(tape.text):  # those of a kind come in order in both lists
            a, b = tape.source(a, b)
            spans, k = held[kind], done[kind]
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            done[kind] = j = k
            while j < len(spans) and spans[j][0] < b:
                j += 1
            if kind == "email" and _meets(held["ip"], a, b):
                continue  # an address as it stands is no host in disguise
            if a >= last[kind] and (j == k or (a <= spans[k][0] and spans[j - 1][1] <= b and (a, b) != spans[k])):
                every.append((kind, a, b))
                last[kind] = b
    order = lambda s: (s[1], KINDS.index(s[0]))
    return sorted(base, key=order), sorted(every, key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, all spans, and how many of these the method added."""
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in texts(batch["text"]):
            base, every = find(t)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            out.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))], ["doc_id", *names])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def masked(text: str) -> str:
    """The text with each found span replaced by its kind; of overlapping spans, the first that starts names all."""
    parts, at = [], 0
    for kind, a, b in find(text)[1]:
        if a >= at:
            parts += (text[at:a], f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(parts) + text[at:] if parts else text


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``masked`` texts; a null text stays null."""
    tune(docs.sparkSession)
    at = docs.columns.index(column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [t if t is None else masked(t) for t in batch.column(at).to_pylist()]
        return batch.set_column(at, column, pa.array(new, pa.string()))

    fields = [StructField(column, StringType()) if i == at else f for i, f in enumerate(docs.schema.fields)]
    return map_arrow(docs, run, StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
