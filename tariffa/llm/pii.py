"""Personal data under disguise, by transducers that keep offsets.

A text passes through transducers, each of which rewrites some stretches: characters (look-alikes of other scripts, wide and
styled forms, digits of any script, odd spaces and dashes, invisible ones), spelled digits, letters that stand for digits, at and
dot disguises of mail addresses, and disguised dots between digits. A transducer gives a list of edits (start, end, new text);
a layer keeps only these edits, so its size follows the disguises and not the text. Identifiers are detected in the last text
by the same rules as in the source, and a span is mapped back layer by layer: a place inside an edit becomes the
edit's whole source stretch, any other moves by the sum of the edits before it.

Base spans are those found in the source itself; they all stay. A span of the last text is added if an edit touches it and no
base span of its kind holds it. Every rule looks at a bounded neighbourhood or moves forwards only, so the
time is linear in the text. Spans are in code points, ordered by start and kind.

Rules that keep clean text alone: spelled digits count from three in a row; a bare ` at ` is a sign only before a domain
with a known last label and a disguised dot, or after a name with a digit, dot or underscore.

Defined results: a null or empty text has no spans. Repeated rows return repeatedly. Columns of docs are kept; new
ones take free names beside clashing ones.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa.llm.common import free, table

KINDS = ("email", "ip", "card", "phone")

# Rules of the source: each linear, as no run is tried again from within.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_ANY_DIGIT = re.compile("[0-9]").search
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones, and full stops of other scripts (fixed values).
_ALIKE = {
    "a": "аɑα", "b": "Ьь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "јϳ", "k": "κк", "l": "ӏ", "m": "м", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγү", "A": "АΑ", "B": "ВΒ",
    "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "ΝԊ", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ",
    "Y": "УΥҮ", "Z": "Ζ", ".": "。․۔",
}
LOOKALIKES = {c: plain for plain, alike in _ALIKE.items() for c in alike}
#: Last labels of domains that count beside a bare word for at or dot (fixed values).
TOP_LABELS = frozenset(
    "com org net edu gov mil int info biz name io co me tv ai app dev eu uk us ca au nz de fr es it nl be ch at se no dk fi pl pt ru ua cz "
    "sk hu ro bg gr tr ie il jp cn kr tw hk sg in br mx ar cl za example test".split())
#: Spelled digits in four languages (fixed values).
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
}
TIMES = {"double": 2, "triple": 3}
PLUS, DOTS = ("plus", "más"), ("dot", "point", "punto", "punkt")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every identifier, leftmost and non-overlapping per kind."""
    found, after, seen = [], 0, 0
    for m in _AT.finditer(text):
        low = max(after, seen)
        head = text[low:m.start()]
        start = low + len(head.rstrip(_LOCAL))
        seen = m.start() + 1  # no local part reaches over a sign
        if start < m.start():
            found.append((0, start, m.end()))
            after = m.end()
    if not _ANY_DIGIT(text):
        return found
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((3, *m.span()))
    return found


Edit = tuple[int, int, str]


class Tape:
    """A text and its edits since the source."""

    def __init__(self, text: str):
        self.text = text
        self.layers: list[tuple[list, list, list, list]] = []

    def apply(self, edits: list[Edit]) -> None:
        """Edits in order, which do not overlap."""
        if not edits:
            return
        parts, at, out, layer = [], 0, 0, ([], [], [], [])
        for s, e, new in edits:
            parts += [self.text[at:s], new]
            out += s - at
            for side, x in zip(layer, (out, out + len(new), s, e)):
                side.append(x)
            out += len(new)
            at = e
        parts.append(self.text[at:])
        self.text = "".join(parts)
        self.layers.append(layer)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span, and whether an edit touches it."""
        touched = False
        for outs, ends, starts, stops in reversed(self.layers):
            a, b = bisect_right(outs, start) - 1, bisect_right(outs, end - 1) - 1
            touched |= b > a or (a >= 0 and start < ends[a])
            start = start if a < 0 else starts[a] if start < ends[a] else start + stops[a] - ends[a]
            end = end if b < 0 else stops[b] if end <= ends[b] else end + stops[b] - ends[b]
        return start, end, touched


@functools.lru_cache(maxsize=1 << 16)
def folded(c: str) -> str | None:
    """What a non-ASCII character stands for, or None if it is itself."""
    kind = unicodedata.category(c)
    if kind == "Cf" or "︀" <= c <= "️":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Pd" or c == "−":
        return "-"
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and c not in "ªº" else LOOKALIKES.get(plain)


def characters(text: str) -> list[Edit]:
    if text.isascii():
        return []
    changed = [c for c in set(text) if c > "\x7f" and folded(c) is not None]
    if not changed:
        return []
    return [(m.start(), m.end(), folded(m.group())) for m in re.finditer("[" + "".join(map(re.escape, changed)) + "]", text)]


def _either(words: list[str]) -> str:
    """A pattern of whole words in any case, by common beginnings: most words of a text end at its first character."""
    def rest(tails: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for w in tails:
            by.setdefault(w[:1], []).append(w[1:])
        ends = by.pop("", None) is not None
        own = "|".join(f"[{c}{c.upper()}]{rest(t)}" for c, t in sorted(by.items()))
        return f"(?:{own}){'?' * ends}" if own else ""
    return rf"(?<!\w)(?=[{''.join(sorted({w[0] + w[0].upper() for w in words}))}]){rest(words)}(?!\w)"


_DIGIT_WORD = re.compile(_either(list(DIGITS)))
_NUMBER_WORD = re.compile(_either([*DIGITS, *TIMES, *PLUS, *DOTS]) + r"|[0-9]+|\+")
_GAP = re.compile(r"[\s,().-]{0,4}")


def spelled(text: str) -> list[Edit]:
    """Digits and signs for runs of number words with at least three spelled digits."""
    words = _DIGIT_WORD.finditer(text)
    if sum(1 for _, _ in zip(range(3), words)) < 3:
        return []
    edits: list[Edit] = []
    run: list[re.Match] = []

    def ended():
        values = [m.group().lower() for m in run]
        if sum(v in DIGITS for v in values) < 3:
            return
        out, k = [], 0
        while k < len(run):
            v, m = values[k], run[k]
            if v in TIMES and k + 1 < len(run) and values[k + 1] in DIGITS:
                out.append((m.start(), run[k + 1].end(), str(DIGITS[values[k + 1]]) * TIMES[v]))
                k += 1
            elif v in DIGITS:
                out.append((*m.span(), str(DIGITS[v])))
            elif v in DOTS and out and k + 1 < len(run):
                out.append((*m.span(), "."))
            elif (v in PLUS or v == "+") and k + 1 < len(run):
                out.append((*m.span(), "+"))
            elif v.isdigit():
                out.append((*m.span(), v))
            else:
                out.append((*m.span(), m.group()))
            k += 1
        for j, (s, e, new) in enumerate(out):
            if text[s:e] != new:
                edits.append((s, e, new))
            if j + 1 < len(out):
                gap, to = text[e:out[j + 1][0]], out[j + 1]
                if gap and not gap.strip(" \t\r\n,-") and (text[s:e] != new or text[to[0]:to[1]] != to[2] or new == "+"):
                    edits.append((e, to[0], ""))
    for m in _NUMBER_WORD.finditer(text):
        if run and (m.start() - run[-1].end() > 4 or not _GAP.fullmatch(text, run[-1].end(), m.start())):
            ended()
            run = []
        run.append(m)
    ended()
    return edits


_MIXED = re.compile(r"(?<![A-Za-z0-9|])[OolI|]{0,3}[0-9][0-9OolI|().+-]*(?: [(+]?[0-9OolI|][0-9OolI|().+-]*)*(?![A-Za-z0-9])")
_STANDS_FOR = str.maketrans("OolI|", "00111")


def digit_letters(text: str) -> list[Edit]:
    """Digits for the letters O, o, l, I and the bar among at least twice as many digits."""
    if not _ANY_DIGIT(text):
        return []
    edits = []
    for m in _MIXED.finditer(text):
        own = m.group()
        letters = [k for k, c in enumerate(own) if c in "OolI|"]
        if letters and sum(c.isdigit() for c in own) >= 2 * len(letters):
            edits += [(m.start() + k, m.start() + k + 1, own[k].translate(_STANDS_FOR)) for k in letters]
    return edits


_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_HIDDEN_DOT = rf"{_OPEN}(?:dot|\.|punto|point|punkt){_CLOSE}|\s{{1,3}}(?:dot|punto|punkt)\s{{1,3}}"
_SIGN = re.compile(rf"{_OPEN}(?:at|@|arroba|arobase|ät){_CLOSE}|\s{{0,3}}@\s{{0,3}}|\s{{1,3}}(?:at|arroba|arobase)\s{{1,3}}", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_NEXT = re.compile(rf"\.|{_HIDDEN_DOT}", re.I)
_BEFORE = re.compile(rf"(?:{_HIDDEN_DOT})\Z", re.I)
_BETWEEN = re.compile(rf"(?<=[0-9])(?:{_HIDDEN_DOT})(?=[0-9])", re.I)
#: Longest local part and domain of a mail address.
LOCAL, DOMAIN = 64, 255


def _domain(text: str, at: int, strict: bool) -> tuple[int, list[tuple[int, int]]] | None:
    """End of the domain that begins at a place, and its dots; strict: only known last labels."""
    m = _LABEL.match(text, at, at + DOMAIN)
    dots, labels, ends = [], [], []
    while m:
        labels.append(m.group())
        ends.append(m.end())
        dot = _NEXT.match(text, m.end(), at + DOMAIN)
        m = dot and _LABEL.match(text, dot.end(), at + DOMAIN)
        if m:
            dots.append(dot.span())
    while dots:
        bare = strict or any(text[s:e].strip().isalpha() for s, e in dots)
        last = labels[-1].lower()
        if last in TOP_LABELS or (not bare and last.isalpha() and 2 <= len(last) <= 24):
            return ends[-1], dots
        dots, labels, ends = dots[:-1], labels[:-1], ends[:-1]
    return None


def _local(text: str, low: int, at: int) -> tuple[int, list[tuple[int, int]]]:
    """Start of the local part that ends at a place, and its hidden dots."""
    low, dots, start = max(low, at - LOCAL), [], at
    while True:
        head = text[low:start]
        start -= len(head) - len(head.rstrip(_LOCAL))
        dot = _BEFORE.search(text, max(low, start - 16), start)
        if not dot or start == at or dot.start() <= low or text[dot.start() - 1] not in _LOCAL:
            return start, dots
        dots.insert(0, dot.span())
        start = dot.start()


def addresses(text: str) -> list[Edit]:
    """Signs and dots of disguised mail addresses."""
    edits, after = [], 0
    for m in _SIGN.finditer(text):
        if m.start() < after:
            continue
        sign = m.group().strip()
        bare = sign.isalpha()
        domain = _domain(text, m.end(), bare or (sign == "@" and m.group() != "@"))
        if not domain:
            continue
        end, dots = domain
        start, inner = _local(text, after, m.start())
        hidden = [x for x in dots if text[x[0]:x[1]] != "."]
        local = text[start:m.start()]
        if start == m.start() or (m.group() == "@" and not hidden and not inner):
            continue
        if bare and not hidden and not (re.search("[0-9._]", local) and re.search("[A-Za-z]", local)):
            continue
        edits += [(*x, ".") for x in inner]
        if m.group() != "@":
            edits.append((*m.span(), "@"))
        edits += [(*x, ".") for x in hidden]
        after = end
    return edits


def dotted_digits(text: str) -> list[Edit]:
    return [(*m.span(), ".") for m in _BETWEEN.finditer(text)] if _ANY_DIGIT(text) else []


TRANSDUCERS = (characters, spelled, digit_letters, addresses, dotted_digits)


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all spans, in order."""
    base = detect(text)
    tape = Tape(text)
    for transducer in TRANSDUCERS:
        tape.apply(transducer(tape.text))
    added = set()
    if tape.layers:
        own = [[(s, e) for k, s, e in base if k == kind] for kind in range(len(KINDS))]
        for kind, s, e in detect(tape.text):
            s, e, touched = tape.source(s, e)
            if touched:
                k = bisect_right(own[kind], (s, len(text))) - 1
                if k < 0 or own[kind][k][1] < e:
                    added.add((s, kind, e, False))
    return sorted([*[(s, k, e, True) for k, s, e in base], *added])


def redacted(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """The text with the kind, in capitals and angle brackets, for every span; spans that overlap become the first one's kind."""
    parts, at = [], 0
    for s, kind, e, _ in found:
        if s >= at:
            parts += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def find(docs: DataFrame, redact: bool = False) -> tuple[DataFrame, list[str]]:
    """All columns of docs with the spans, on request the text without them, and the names of these columns."""
    names = [free(docs, "spans")]
    typed = docs.withColumn(names[0], F.lit(None).cast("array<struct<kind:string,start:long,end:long,base:boolean>>"))
    if redact:
        names.append(free(typed, "redacted"))
        typed = typed.withColumn(names[1], F.lit(None).cast("string"))
    at = docs.columns.index("text")
    one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            found = [spans(t) for t in texts]
            added = [pa.array([[{"kind": KINDS[k], "start": s, "end": e, "base": x} for s, k, e, x in f] for f in found], one)]
            if redact:
                added.append(pa.array([redacted(t, f) for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *names])
    return docs.mapInArrow(run, typed.schema), names


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count base spans, n_added the spans that the transducers add."""
    out, (own,) = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(own, lambda x: x["base"])

    def line(xs):
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col(own)).alias("spans"),
                      (F.size(own) - F.size(base)).cast("long").alias("n_added"))
