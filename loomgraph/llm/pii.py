"""Personal data in texts: emails, IP addresses, card and phone numbers, also where they are disguised.

Base spans are what fixed patterns find in the text as it is. Beyond them, a transducer rewrites a text piece by piece
(look-alike letters and digits to ASCII, zero-width characters to nothing, "at" and "dot" disguises to their signs, runs
of spelled digits to digits, and letters among digits too) and keeps for every output character the source characters that it stands for. The same
patterns find identifiers in its output, and their spans are mapped back. Only stretches around a disguise are
rewritten (`REACH` characters to both sides, and on to the end of the token or number there), so that plain text yields base
spans alone. A disguised email has at most 5 labels of 64 characters before its sign and 6 of 63 after it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ship, tidy

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A quad can only begin where a run of digits does, and its runs never give digits back: the same matches, in linear time.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: each @ has one run of local characters before it, back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind. Matches that fail a test are dropped."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the transducer ----

#: Letters of other scripts that look like an ASCII letter or digit.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁɡһԛԝкмтнвАВЕКМНОРСТУХІЈЅαορνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdghqwkmthbABEKMHOPCTYXIJSaopviktABEZHIKMNOPTYX",
        strict=True,
    )
)
INVISIBLE = frozenset("​‌‍⁠﻿­‎‏᠎")
DASHES, DOTS, ATS = "‐‑‒–—−﹣－", "。．․﹒｡", "＠﹫"
#: Words for the digits, in the languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_digit_word = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_spelled = re.compile(rf"(?<![^\W_])(?:{_digit_word}|[0-9]+)(?:(?:[ \t]*[-.,][ \t]*|[ \t]+)(?:{_digit_word}|[0-9]+|plus|dot|point))*(?![^\W_])", re.I)
_one = re.compile(rf"{_digit_word}(?![^\W\d_])", re.I)

_wrap_at = r"[ \t]*(?:\[[ \t]*(?:at|ät|a|@)[ \t]*\]|\([ \t]*(?:at|ät|a|@)[ \t]*\)|\{[ \t]*(?:at|ät|a|@)[ \t]*\}|<[ \t]*(?:at|@)[ \t]*>|_at_|-at-)[ \t]*|[ \t]+(?:at|ät|arroba|arobase)[ \t]+|[ \t]+@[ \t]*|[ \t]*@[ \t]+"
_wrap_dot = r"[ \t]*(?:\[[ \t]*(?:dot|punkt|point|punto|\.)[ \t]*\]|\([ \t]*(?:dot|punkt|point|punto|\.)[ \t]*\)|\{[ \t]*(?:dot|punkt|point|punto|\.)[ \t]*\}|<[ \t]*(?:dot|\.)[ \t]*>|_dot_|-dot-)[ \t]*|[ \t]+(?:dot|punkt|punto|point)[ \t]+|[ \t]+\.[ \t]+"
_dot, _at = re.compile(_wrap_dot, re.I), re.compile(_wrap_at, re.I)
_label, _loc = r"[A-Za-z0-9][A-Za-z0-9-]{0,62}", r"[A-Za-z0-9_%+-]{1,64}"
_disguised_email = re.compile(rf"(?<![A-Za-z0-9_%+-])(?P<local>{_loc}(?:(?:\.|{_wrap_dot}){_loc}){{0,4}}+)(?P<at>@|{_wrap_at})(?P<domain>{_label}(?:(?P<dots>\.|{_wrap_dot}){_label}){{1,5}})", re.I)
_disguised_ip = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:\.|{_wrap_dot})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_odd = re.compile("[^\x00-\x7fÀ-ɏ]")
_spelled_hint = re.compile(rf"(?<![^\W_]){_digit_word}(?:[ \t]*[-.,]?[ \t]*)(?:{_digit_word}|[0-9])", re.I)
_dot_hint = re.compile(r"dot|punkt|punto|point|arroba|arobase|[\[({<_-][ \t]*(?:at|ät|a|@|\.)[ \t]*[\])}>_-]|[ \t]@|@[ \t]", re.I)
_ascii = {}


def _fold_char(c: str) -> str:
    """The ASCII that a character is a disguise of, or itself; nothing for invisible ones."""
    if c < "\x80":
        return c
    if (x := _ascii.get(c)) is None:
        x = "" if c in INVISIBLE else LOOKALIKES.get(c) or ("-" if c in DASHES else "." if c in DOTS else "@" if c in ATS else "")
        if not x and c not in INVISIBLE:
            d = unicodedata.digit(c, None) if unicodedata.category(c) == "Nd" else None
            k = unicodedata.normalize("NFKC", c)
            x = str(d) if d is not None else k if len(k) == 1 and " " <= k < "\x7f" and (k.isalnum() or k in "@.+-_() ") else c
        if len(_ascii) < 4096:
            _ascii[c] = x
    return x


class Mapped:
    """A rewritten text and, for each of its characters, the source span that it stands for."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: list[int], end: list[int]) -> None:
        self.text, self.start, self.end = text, start, end

    @classmethod
    def of(cls, text: str, base: int = 0) -> Mapped:
        return cls(text, list(range(base, base + len(text))), list(range(base + 1, base + len(text) + 1)))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]

    def folded(self) -> Mapped:
        out, s, e = [], [], []
        for c, a, b in zip(self.text, self.start, self.end, strict=True):
            x = _fold_char(c)
            if x:
                out.append(x)
                s.append(a)
                e.append(b)
        return Mapped("".join(out), s, e)

    def replaced(self, pieces: list[tuple[int, int, str]]) -> Mapped:
        """Each (start, end, text) is put in place of what it covers; its characters all stand for the whole piece."""
        out, s, e, at = [], [], [], 0
        for a, b, x in pieces:
            out += [self.text[at:a], x]
            s += self.start[at:a] + [self.start[a]] * len(x)
            e += self.end[at:a] + [self.end[b - 1]] * len(x)
            at = b
        return Mapped("".join(out) + self.text[at:], s + self.start[at:], e + self.end[at:])


def _undotted(m: Mapped) -> list[tuple[str, int, int]]:
    """Emails and addresses behind at/dot disguises: a match must look like one as a whole, with a short last label."""
    found = []
    for x in _disguised_email.finditer(m.text):
        domain = _dot.sub(".", x["domain"])
        plain_at, plain_dots = x["at"] == "@", domain == x["domain"]
        if plain_at and plain_dots and _dot.sub(".", x["local"]) == x["local"]:
            continue  # an email as it is
        spoken = re.fullmatch(r"[ \t]+(?:at|ät|arroba|arobase)[ \t]+", x["at"], re.I)
        if spoken and plain_dots and domain.count(".") and not re.search(r"\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|co)$", domain, re.I):
            continue  # "at" before some dotted word is prose
        local = x["local"]
        parts = list(_dot.finditer(local))
        skip = parts[-1].end() if spoken and parts and re.fullmatch(r"[ \t]+\.[ \t]+", parts[-1].group()) else 0
        labels = domain.split(".")
        end = x.end("domain")
        if not re.fullmatch(r"[A-Za-z]{2,24}", labels[-1]) or labels[-1].lower() in ("at", "dot", "point", "punkt", "punto"):
            continue
        found.append(("email", *m.source(x.start("local") + skip, end)))
    for x in _disguised_ip.finditer(m.text):
        quad = _dot.sub(".", x.group())
        if quad != x.group() and all(int(p) <= 255 for p in quad.split(".")):
            found.append(("ip", *m.source(*x.span())))
    return found


def _respelled(m: Mapped) -> Mapped | None:
    """m with runs of spelled digits written as digits; None if there is no run of two or more."""
    pieces = []
    for run in _spelled.finditer(m.text):
        if len(_one.findall(run.group())) < 2:
            continue
        at = run.start()
        tokens = list(re.finditer(rf"{_digit_word}|[0-9]+|plus|dot|point|[-.,]", run.group(), re.I))
        previous = None
        for t in tokens:
            w = t.group().lower()
            x = SPELLED.get(w, {"plus": "+", "dot": ".", "point": ".", ",": ""}.get(w, w))
            a = at + t.start()
            if previous is not None and previous < a:
                pieces.append((previous, a, ""))  # the gap between two digits
            pieces.append((a, at + t.end(), x))
            previous = at + t.end()
    if not pieces:
        return None
    lead = re.compile(r"(?<![^\W_])plus[ \t]+\Z", re.I)
    first = pieces[0][0]
    if p := lead.search(m.text, max(0, first - 12), first):
        pieces.insert(0, (p.start(), first, "+"))
    return m.replaced(pieces)


#: Letters that stand for digits among digits.
AS_DIGITS = str.maketrans("OoIl|", "00111")
_numeral = re.compile(r"(?<![^\W_])[+]?[0-9OoIl|]+(?:[ ().-]{1,2}[0-9OoIl|]+)*(?![^\W_])")
_numeral_hint = re.compile(r"[0-9][ ().-]{0,2}[OoIl|]|[OoIl|][ ().-]{0,2}[0-9]")


def _numbered(m: Mapped) -> Mapped | None:
    """m with letters among digits as digits, in runs that are digits for half at least; None if there is none."""
    pieces = []
    for run in _numeral.finditer(m.text):
        letters = [k for k, c in enumerate(run.group()) if c in "OoIl|"]
        if letters and len(_digits(run.group())) >= len(letters):
            pieces += [(run.start() + k, run.start() + k + 1, run.group()[k].translate(AS_DIGITS)) for k in letters]
    return m.replaced(pieces) if pieces else None


#: Characters around a mark that are looked at: more than a local part and a domain label have together with a disguised sign.
REACH = 160
#: Characters that a number may go on with, over white space too.
NUMERIC = frozenset("0123456789OoIl|().+-")


def _stretches(text: str) -> list[tuple[int, int]]:
    """Where a disguise may be, with what is around it; overlapping stretches are one.

    A stretch ends at white space, never inside a token, and not between tokens that a number may run over.
    """
    marks = [m.span() for p in (_odd, _spelled_hint, _dot_hint, _numeral_hint) for m in p.finditer(text)]
    near: list[tuple[int, int]] = []
    for a, b in sorted(marks):
        a, b = max(0, a - REACH), min(len(text), b + REACH)
        if near and a <= near[-1][1]:
            near[-1] = (near[-1][0], max(b, near[-1][1]))
        else:
            near.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in near:
        done = out[-1][1] if out else 0
        while a > done:  # to the start of its token, and of those before that a number may have begun in
            if not text[a - 1].isspace():
                a -= 1
                continue
            at = a - 1
            while at > done and text[at - 1].isspace():
                at -= 1
            if at == 0 or text[at - 1] not in NUMERIC:
                break
            a = at
        while b < len(text):
            if b and not text[b - 1].isspace() and not text[b].isspace():
                b += 1
                continue
            at = b
            while at < len(text) and text[at].isspace():
                at += 1
            if at == len(text) or text[at] not in NUMERIC and (at > b or text[b - 1].isspace()):
                break
            b = at + 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the transducer finds beyond the base spans: no span that overlaps a base span of its kind or another."""
    found: list[tuple[str, int, int]] = []
    for lo, hi in _stretches(text):
        m = Mapped.of(text[lo:hi], lo)
        f = m.folded() if _odd.search(m.text) else m
        views = [f, *(r for r in (_respelled(f), _numbered(f)) if r is not None)]
        for k, v in enumerate(views):
            if v is not m:
                for kind, a, b in base_spans(v.text):
                    if k and kind == "email":
                        continue
                    found.append((kind, *v.source(a, b)))
            found += _undotted(v)
    out: list[tuple[str, int, int]] = []
    taken = sorted((a, b) for _, a, b in base)
    for s in sorted(set(found), key=lambda s: (s[1] - s[2], s[1], KINDS.index(s[0]))):
        if not any(a < s[2] and s[1] < b for a, b in taken):
            out.append(s)
            taken.append(s[1:])
    return out


def find(text: str | None, disguises: bool = True) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text; a null text is empty."""
    text = text or ""
    base = base_spans(text)
    more = added_spans(text, base) if disguises and text else []
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base, spans = find(text)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base counts of each kind, base_sha256, spans (all of them), n_spans: one row for each row of docs.

    Null and empty texts have no span (the digest is that of an empty text). Repeated rows give repeated rows; other
    columns are not read; an empty table gives no row.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_scan), SCHEMA)


def redacted(text: str | None, mask: str = "[{kind}]") -> str:
    """The text with each span, disguised or not, replaced by its kind."""
    text = text or ""
    out, at = [], 0
    for kind, a, b in find(text)[1]:
        if a >= at:
            out += [text[at:a], mask.format(kind=kind.upper())]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]
