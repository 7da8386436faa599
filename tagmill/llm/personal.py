"""Personal data in texts, plain and disguised, with spans in the source text.

Plain e-mail addresses, IP addresses, card and phone numbers are found by four fixed patterns. Every text then passes three
finite-state transducers, one after the other: look-alike, full-width, combining and zero-width characters; digits spelled
as words; ``at`` and ``dot`` as words or in brackets. A transducer is a table from (state, class of a token) to (state,
output); outside its accepting paths it copies. Whatever is written keeps the source span it stems from, so what the four
patterns find in the normalised text maps back to source characters. A span found that way is added unless it lies within
a plain one of its kind: ``jоhn@example.com`` with a Cyrillic letter has the plain span after that letter and the whole one.

A number of more than 19 digits that was spelled is split if it is a row of whole card numbers. A free "at" before a plain
domain makes an address only of a name with inner dots, underscores, plus or percent signs, or just after words such as
"mail" or "contact" ("look at example.com" names a place).

Cases: a null text counts as empty; spans count code points, ends exclusive; rows that repeat, and rows without an id, are
rows of their own; an empty table gives an empty result; other columns are ignored. All scans are linear in the text's
length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive, and tried only where a run of digits begins: no other start can match.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = len(text[done:at].rstrip(_LOCAL)) + done
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
        done = end.end() if end else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def _luhn(digits: list[int]) -> bool:
    return (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = [int(c) for c in m[0] if c not in " -"]
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield m.span()


_FINDERS = (_emails, _ips, _cards, _phones)


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all plain matches."""
    return sorted((s, k, e) for k, f in enumerate(_FINDERS) for s, e in f(text))


def _pairs(listed: str) -> dict[str, str]:
    return {x[0]: x[1:] for x in listed.split()}


# Letters of other scripts (Cyrillic, Greek, Armenian) with the Latin ones that they look like.
LOOKALIKES = _pairs("АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX УY аa еe ѕs іi јj оo рp сc хx уy һh ԁd ԛq ԝw")
LOOKALIKES |= _pairs("ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo αa νv ιi κk ρp τt υu χx")
LOOKALIKES |= _pairs("օo ոn սu հh ցg յj զq ՕO ՏS ՍU")
LOOKALIKES |= dict.fromkeys("\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad", "") | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212\ufe63", "-")
LOOKALIKES |= dict.fromkeys("\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " ") | dict.fromkeys("\u2024\u3002\uff61", ".") | {"\ufe6b": "@"}
LOOKALIKES |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
LOOKALIKES |= {chr(c): "" for c in range(0x300, 0x370)}  # combining marks
_ODD = re.compile(f"[{''.join(map(re.escape, LOOKALIKES))}]|(?![0-9])\\d")
# Digits in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: Dots in disguise: words between blanks, or words and dots in brackets.
_DOT = r"(?:[ \t]+(?:dot|punkt|point|punto)[ \t]+|[ \t]*[\[({<][ \t]*(?:dot|punkt|point|punto|\.)[ \t]*[\])}>][ \t]*)"
_SPELLED = re.compile(rf"(?i)(?<![^\W_]){_NUMBER}(?![^\W_])")
_ITEM = re.compile(rf"(?i)(?<![^\W_])(?:(?P<N>{_NUMBER})|(?P<P>plus))(?![^\W_])|(?P<F>(?<![^\W_])(?<![0-9]\.)[0-9](?![^\W_]|\.[0-9]))")
#: What stands between two items: blanks, commas, hyphens and line ends, or one dot, plain or in disguise.
_GAP = re.compile(rf"(?i)(?P<blank>[ \t\r\n,-]+)|(?P<dot>[ \t]*\.[ \t]*|{_DOT})|(?P<none>)")

#: The transducer of spelled digits: (state, class) to (state, output); an output of None stands for the item's digit.
#: Classes: a spelled number N, a single figure F, plus P, between them "blank" and "dot"; nothing between two items ("none")
#: and anything else ends the run.
DIGITS = {
    ("out", "N"): ("number", None), ("out", "F"): ("number", None), ("out", "P"): ("plus", "+"),
    ("plus", "blank"): ("plus", ""), ("plus", "N"): ("number", None), ("plus", "F"): ("number", None),
    ("number", "blank"): ("between", ""), ("number", "dot"): ("between", "."),
    ("between", "N"): ("number", None), ("between", "F"): ("number", None),
}
#: A run is rewritten if it has so many items or more, at least a third of them spelled, or begins with a spelled plus.
RUN_ITEMS = 4

#: The transducer of addresses, from the at sign on: (state, class) to (state, output). The first state says how the at is
#: written: in brackets or between blanks (sure), as a bare word (free), or plainly. Accepting are the states in ACCEPT; in
#: "free+" the name and the words before it decide. Classes: a label of a domain, a dot, a dot in disguise.
ADDRESS = {
    ("sure", "label"): ("sure1", None), ("sure1", "."): ("sure.", None), ("sure1", "dot"): ("sure.", "."), ("sure.", "label"): ("sure+", None), ("sure+", "."): ("sure.", None), ("sure+", "dot"): ("sure.", "."),
    ("free", "label"): ("free1", None), ("free1", "."): ("free.", None), ("free.", "label"): ("free+", None), ("free+", "."): ("free.", None), ("free1", "dot"): ("sure.", "."), ("free+", "dot"): ("sure.", "."),
    ("plain", "label"): ("plain1", None), ("plain1", "."): ("plain.", None), ("plain.", "label"): ("plain2", None), ("plain2", "."): ("plain.", None), ("plain1", "dot"): ("sure.", "."),
    ("part", "."): ("part.", None), ("part", "dot"): ("part.", "."), ("part.", "figures"): ("part", None),
}
ACCEPT = {"sure+", "free+"}
_AT = re.compile(r"(?i)(?<![ \t])(?:(?P<sure>[ \t]*+[\[({<][ \t]*+(?:at|@|chez|arroba)[ \t]*+[\])}>][ \t]*+|[ \t]++@[ \t]++)|(?P<free>[ \t]++(?:at|arroba)[ \t]++))|(?P<plain>@)")
_STEP = re.compile(rf"(?i)(?P<label>[a-z0-9-]+)|(?P<dot>{_DOT})|(?P<point>\.)")
_IP_STEP = re.compile(rf"(?i)(?P<figures>[0-9]+)(?![^\W_])|(?P<dot>{_DOT})|(?P<point>\.)")
_IP_DOT = re.compile(rf"(?i)(?<=[0-9]){_DOT}(?=[0-9])")
_TOP = re.compile(r"[A-Za-z]{2,24}")
#: Names that are no words, and what asks for an address just before a name.
_NO_WORD = re.compile(r"(?i)[a-z][a-z0-9-]*(?:[._%+][a-z][a-z0-9-]*)+")
_CUE = re.compile(r"(?i)(?<![^\W_])(?:e?-?mails?|write|contact|reach|address|schreib\w*|adresse|écri\w*|courriel|escrib\w*|correo)[ \t:,]+(?:(?:to|is|an|ist|à|est|a|es)[ \t:,]+)?$")
_PRONOUNS = frozenset("me us you him her it them this that one someone anyone everyone uns mich ihn sie nous moi nos".split())


class Tape:
    """A text with the source span of each character; ``spelled`` are the source spans of rewritten runs of digits."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.spelled = text, None, None, []

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the text."""
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans (start, end) by a text whose characters all stem from the whole span."""
        if not edits:
            return
        if self.starts is None:
            self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            starts += self.starts[at:s] + [self.starts[s]] * len(new)
            ends += self.ends[at:s] + [self.ends[e - 1]] * len(new)
            at = e
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def _characters(tape: Tape) -> None:
    """The transducer of characters: one state, whose arcs are LOOKALIKES and the decimals of all scripts."""
    if not tape.text.isascii():
        tape.rewrite([(*m.span(), LOOKALIKES[m[0]] if m[0] in LOOKALIKES else str(unicodedata.decimal(m[0]))) for m in _ODD.finditer(tape.text)])


def _digits(tape: Tape) -> None:
    """The transducer of spelled digits."""
    if not _SPELLED.search(tape.text):
        return
    edits, state, run, items, spelled, end = [], "out", [], 0, 0, 0

    def close() -> None:
        if items >= RUN_ITEMS and (3 * spelled >= items or run[0][2] == "+"):
            edits.extend(run)
            tape.spelled.append(tape.source(run[0][0], run[-1][1]))

    for m in _ITEM.finditer(tape.text):
        gap = _GAP.fullmatch(tape.text, end, m.start()) if state != "out" else None
        between = DIGITS.get((state, gap.lastgroup)) if gap else None
        arc = DIGITS.get((between[0], m.lastgroup)) if between else None
        if arc:
            run.append((end, m.start(), between[1]))
        else:
            close()
            arc, run, items, spelled = DIGITS["out", m.lastgroup], [], 0, 0
        word = m[0].lower()
        run.append((*m.span(), SPELLED.get(word, m[0]) if arc[1] is None else arc[1]))
        state, end = arc[0], m.end()
        items += m.lastgroup != "P"
        spelled += m.lastgroup == "N"
    close()
    tape.rewrite([x for x in edits if tape.text[x[0] : x[1]] != x[2]])


def _walk(text: str, at: int, state: str, step: re.Pattern, accept: set[str]) -> tuple[str, int, list[tuple[int, int, str]]]:
    """The last accepting state reached over ADDRESS from ``at`` on, its end, and the edits on the way."""
    edits, found = [], ("", at, 0)
    while m := step.match(text, at):
        arc = ADDRESS.get((state, "." if m.lastgroup == "point" else m.lastgroup))
        if arc is None:
            break
        if arc[1] is not None:
            edits.append((*m.span(), arc[1]))
        state, at = arc[0], m.end()
        if state in accept:
            found = (state, at, len(edits))
    return found[0], found[1], edits[: found[2]]


def _addresses(tape: Tape) -> None:
    """The transducer of at and dot, and that of the dots of IP addresses, which shares its table."""
    text, edits, done, last = tape.text, [], 0, 0
    for m in _AT.finditer(text):
        low, last = max(done, last), m.end()  # no name crosses the at before it
        if m.start() < done:
            continue
        start = low + len(text[low : m.start()].rstrip(_LOCAL))
        if start == m.start():
            continue
        state, end, found = _walk(text, m.end(), m.lastgroup, _STEP, ACCEPT)
        if state == "free+":
            name, top = text[start : m.start()], text[m.end() : end].rpartition(".")[2]
            cued = name.lower() not in _PRONOUNS and _CUE.search(text, max(0, start - 40), start)
            if not (_TOP.fullmatch(top) and (_NO_WORD.fullmatch(name) or cued)):
                continue
        if state:
            edits += [(*m.span(), "@"), *found] if m[0] != "@" else found
            done = end
    taken, done, last = {i for s, e, _ in edits for i in range(s, e)}, 0, 0
    for m in _IP_DOT.finditer(text):
        low, last = max(done, last), m.end()
        if m.start() >= done and m.start() not in taken:
            start = low + len(text[low : m.start()].rstrip("0123456789."))
            first = _IP_STEP.match(text, start)
            if first and first.lastgroup == "figures":
                _, end, found = _walk(text, first.end(), "part", _IP_STEP, {"part"})
                edits += found
                done = end
    tape.rewrite(sorted(edits))


TRANSDUCERS = (_characters, _digits, _addresses)


def _row_of_cards(digits: list[int]) -> list[int]:
    """The lengths of card numbers that make up the digits; empty if there are none."""
    n = len(digits)
    step: list[int] = [0] * n + [-1]
    for i in range(n - 12, -1, -1):
        for size in (16, 15, 14, 13, 12, 19, 18, 17):  # the commonest first
            if i + size <= n and step[i + size] and _luhn(digits[i : i + size]):
                step[i] = size
                break
    out, i = [], 0
    while i < n and step[i]:
        out.append(step[i])
        i += step[i]
    return out if i == n else []


def _split_cards(tape: Tape) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(tape.text) if tape.spelled else ():
        at = [i for i in range(*m.span()) if tape.text[i] not in " -"]
        if len(at) > 19:
            s, e = tape.source(*m.span())
            if any(x < e and s < y for x, y in tape.spelled):
                i = 0
                for size in _row_of_cards([int(tape.text[j]) for j in at]):
                    yield at[i], at[i + size - 1] + 1
                    i += size


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of matches in the normalised text that do not lie within a plain one of their kind."""
    tape = Tape(text)
    for transducer in TRANSDUCERS:
        transducer(tape)
    if tape.starts is None:
        return []
    out = set()
    for s, k, e in [*plain(tape.text), *((s, 2, e) for s, e in _split_cards(tape))]:
        s, e = tape.source(s, e)
        if not any(kind == k and start <= s and e <= end for start, kind, end in base):
            out.add((s, k, e))
    return sorted(out)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array<struct<kind string, start int, end int, base boolean>> in order of start, then kind."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for text in pdf["text"]:
                base = plain(text)
                spans = sorted([(*b, True) for b in base] + [(*d, False) for d in disguised(text, base)])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": own} for s, k, e, own in spans])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "spans": out})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInPandas(scan, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    digest = F.sha2(joined(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, joined(F.col("spans")).alias("spans"))


QUERIES = {"op8_personal_data": op8_personal_data}
ORACLE: dict = {}
