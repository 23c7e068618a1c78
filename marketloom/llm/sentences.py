"""Sentence units of texts in many languages and scripts.

A pushdown automaton reads the few characters that matter, in one pass over each paragraph:
terminators of each script, quotation marks, brackets, dashes and the markers of list items. Its
stack holds the open quotations and brackets, each with the place in the output at which it was
opened; a closing mark pops the nearest frame it fits and with it everything that was put out
since, so nothing inside a closed pair ends a unit. What is left when the paragraph ends was never
inside a closed pair. A second stack holds the levels of lists: a marker counts only where it
opens a level or goes on with one. Abbreviations are looked up in a trie read backwards from the
period. Every step is linear in the text, however deep or unmatched the marks are. Only blank
lines end a unit by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by what may follow them.
#: Titles and references that never end a sentence.
NEVER = (
    "mr mrs ms messrs dr prof rev hon rt st mt ft sen rep gov capt lt col sgt gen fr hr hrn frl "
    "cf vs viz e.g i.e approx resp "
    "z.b z. b d.h d. h u.a u. a i.d.r s.o s.u o.ä vgl bzw sog evtl ggf inkl "
    "mm mme mlle mgr me "
    "sr sra srta dra d.ª dña uds ud p.ej p. ej ej ee.uu excmo ilmo "
    "κ κα κκ βλ δηλ π.χ "
    "डॉ श्री प्रो सुश्री ई "
    "د أ م ص ج "
).strip()
#: References that end no sentence before a number.
NUMBERED = "no nos nr nro núm num n p pp pág págs pag s art arts para paras par abs al vol vols fig tab ch cap chap kap sec sect cl bd αρ σελ παρ αριθ ziff rn tz ref nº"
#: Abbreviations that may end a sentence; a capital after them decides.
OFTEN_LAST = "etc usw usf etw hrs a.m p.m ff ibid jr sen co inc ltd corp bros κλπ κ.λπ κτλ"
#: Months, which end no sentence before a number.
MONTHS = "jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil août oct déc okt dez mär ene abr ago dic"
#: Words before a German ordinal.
BEFORE_ORDINAL = frozenset("am der die das dem den des im vom zum zur beim bis seit ab ins unser unserer unserem ihr ihrer jeder jedem jeden".split())
GERMAN_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
#: Words that carry a sentence on after a closing quotation mark, in scripts without capitals.
CARRIES_ON = (
    *("と", "って", "という", "といった", "なる", "など", "の", "を", "は", "が", "に", "で", "も", "へ"),
    *("然后", "随后", "接着", "并", "而", "便", "就", "之后", "后", "的", "等", "，", "、"),
    *("और", "तथा", "फिर", "कहा", "कहकर", "कह", "कि"),
    *("ثم", "وقال", "قال", "وجلس", "و", "اور", "پھر", "کہا", "کہہ"),
    *("แล้ว", "และ", "ก่อน"),
)
#: Japanese particles before an ellipsis within a sentence.
PARTICLES = frozenset("はがをにでともへのて、")

_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‘": "’", "‹": "›", "(": ")", "[": "]", "（": "）", "［": "］", "【": "】", "〔": "〕", "〈": "〉", "《": "》"}
_BRACKETS = frozenset("([（［【〔")
_CLOSE = frozenset("”“»」』’›)]）］】〕〉》\"")
_DASHES = "—–"
_STRONG = frozenset("。！？।॥۔؟⁉‼⁈⁇｡")
_INVISIBLE = "​‌‍­﻿⁠"
_EVENT = regex.compile(r"[.!?…;;。！？।॥۔؟⁉‼⁈⁇｡]+|[“”„«»「」『』‘’‹›()\[\]（）［］【】〔〕〈〉《》\"]|(?<=\s|^)[—–](?=\s|\w)|(?:ครับ|ค่ะ|คะ)(?=\s|$|[(\[“”\"'«])")
_BLANK_LINE = regex.compile(r"\r?\n(?:[^\S\n]*\r?\n)+|\r(?:[^\S\n\r]*\r)+")
_SPACE = regex.compile(r"\s*")
_LAST_SPACE = regex.compile(r"(?r)\s")
_DASH_ASIDE = regex.compile(r"([—–])\s*[^—–.!?…\n。！？]+[.!?…。！？]+\s*\1")
_MARKER = regex.compile(r"[0-9]+|[A-Za-z]|[ivxIVX]{2,}")
_ITEM = regex.compile(r"(?:(?<=[\n\r])|\A)[^\S\n\r]*(?:(\()?([0-9]+|[ivx]+|[IVX]+|[A-Za-z])([.)])|([-*•‣▪◦·]))(?=[^\S\n\r]+\S)")
_ADDRESS = regex.compile(r"\w+[./@]\w")
_WORD = regex.compile(r"\w+")


def _trie(kinds: dict[str, str]) -> dict:
    root: dict = {}
    for kind, words in kinds.items():
        for w in words:
            node = root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node.setdefault("", kind)
    return root


def _words(text: str) -> list[str]:
    """Abbreviations of a list; a single letter followed by a single letter is one of two parts."""
    out, parts = [], text.split()
    i = 0
    while i < len(parts):
        if parts[i] in ("z.", "d.", "u.", "p.") and i + 1 < len(parts):
            out.append(f"{parts[i]} {parts[i + 1]}")
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


_ABBREVIATIONS = _trie({"never": _words(NEVER), "numbered": _words(NUMBERED), "last": _words(OFTEN_LAST), "month": _words(MONTHS)})


def _abbreviation(text: str, lo: int, dot: int) -> str | None:
    """Kind of the longest abbreviation that ends at a period; read backwards through the trie."""
    node, found, i = _ABBREVIATIONS, None, dot - 1
    while i >= lo:
        c = text[i]
        if c in _INVISIBLE:
            i -= 1
            continue
        node = node.get(" " if c.isspace() else c.lower())
        if node is None:
            break
        if "" in node and (i == lo or not (text[i - 1].isalnum() or text[i - 1] in "._")):
            found = node[""]
        i -= 1
        while c.isspace() and i >= lo and text[i].isspace():
            i -= 1
    return found


#: Kinds of events: a run of terminators, a dash, a closed pair, a list marker.
_END, _DASH, _PAIR, _LIST = range(4)


def _events(text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a paragraph's events outside all closed pairs; of a pair its two marks."""
    out: list[tuple[int, int, int]] = []
    frames: list[tuple[str, int, int]] = []  # mark, position, events put out before it
    closed_by: dict[str, list[int]] = {}  # closing mark -> depths of the frames it fits
    items = {m.end() - 1: m.start() for m in _ITEM.finditer(text, lo, hi)}
    # bullets are no events of the pattern below; those in ascending order are let in between
    bullets = [(_LIST, start, p + 1) for p, start in items.items() if text[p] not in ".)"]
    k = 0
    for m in _EVENT.finditer(text, lo, hi):
        c, i = m.group(), m.start()
        while k < len(bullets) and bullets[k][1] <= i:
            out.append(bullets[k])
            k += 1
        if i in items and c[0] in ".)":
            out.append((_LIST, items[i], i + 1))
            continue
        if c in _DASHES:
            out.append((_DASH, i, m.end()))
            continue
        if c not in _OPEN and c not in _CLOSE:
            out.append((_END, i, m.end()))
            continue
        if c == "’" and i > lo and text[i - 1].isalnum() and i + 1 < hi and text[i + 1].isalnum():
            continue  # an apostrophe
        if depths := closed_by.get(c):
            depth = depths[-1]
            _, opened, before = frames[depth]
            for mark, _, _ in reversed(frames[depth:]):
                for x in _OPEN.get(mark, mark):
                    closed_by[x].pop()
            del frames[depth:], out[before:]
            out.append((_PAIR, opened, i))
        elif c in _OPEN or c == '"':
            for x in _OPEN.get(c, c):
                closed_by.setdefault(x, []).append(len(frames))
            frames.append((c, i, len(out)))
    return out + bullets[k:]


class _Levels:
    """The stack of list levels of a text: the style of each and the number of its last item."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []

    def takes(self, text: str, start: int, end: int, opens: bool) -> bool:
        """Whether the marker text[start:end] goes on with a level, or opens one where that may be."""
        marker = text[start:end].strip()
        word = marker.strip("().")
        style, numbers = self._read(marker, word)
        for depth in range(len(self.stack) - 1, -1, -1):
            if any((s, n - 1) == self.stack[depth] or (s == self.stack[depth][0] and n == 0) for s, n in ((style + k, n) for k, n in numbers)):
                kind, last = self.stack[depth]
                del self.stack[depth:]
                self.stack.append((kind, last + 1 if numbers[0][1] else 0))
                return True
        first = next(((style + k, n) for k, n in numbers if n <= 1), None)
        if first is None or not opens:
            return False
        self.stack = [x for x in self.stack if x[0] != first[0]]
        self.stack.append(first)
        return True

    @staticmethod
    def _read(marker: str, word: str) -> tuple[str, list[tuple[str, int]]]:
        """Style of a marker and what it may count: (kind, number), 0 for a bullet."""
        if not word or not word.isalnum():
            return marker, [("*", 0)]
        style = marker.replace(word, "", 1)
        if word.isdigit():
            return style, [("1", int(word))]
        case = "A" if word.isupper() else "a"
        readings = []
        if set(word.lower()) <= set("ivx"):
            units = {"i": 1, "v": 5, "x": 10}
            values = [units[c] for c in word.lower()]
            readings.append((case + "i", sum(-v if v < max(values[j:]) else v for j, v in enumerate(values))))
        if len(word) == 1:
            readings.append((case, ord(word.lower()) - ord("a") + 1))
        return style, readings


def _next(text: str, i: int, hi: int) -> int:
    """Position of the next character that is seen, from i on."""
    while i < hi and (text[i].isspace() or text[i] in _INVISIBLE):
        i += 1
    return i


def _carries_on(text: str, i: int, hi: int) -> bool:
    """After a closed quotation that ends like a sentence: whether the sentence around it goes on."""
    c = text[i]
    if c.islower() or c in ",;:)]，、；：）·.!?…。！？؛،":
        return True
    if c in _DASHES:
        return _DASH_ASIDE.match(text, i, hi) is None
    return not c.isupper() and text.startswith(CARRIES_ON, i)


def _seen_before(text: str, lo: int, at: int) -> str:
    """The last character before a position that is no white space; empty if there is none."""
    while at > lo and text[at - 1].isspace():
        at -= 1
    return text[at - 1] if at > lo else ""


def _ends(text: str, lo: int, at: int, end: int, hi: int, token: int, compound: bool) -> bool:
    """Whether the terminators text[at:end], outside all closed pairs, end the unit begun at lo.

    token is where the characters before them without white space begin; compound says that
    there are other terminators among those.
    """
    run = text[at:end].rstrip(_INVISIBLE)
    n = _next(text, end, hi)
    if n >= hi:
        return True
    c, gap = text[n], n > end
    if any(x in _STRONG for x in run):
        return c not in _CLOSE
    if c in ",;:)]，、；：）·؛،":
        return False
    if c in _DASHES:
        after = _next(text, n + 1, hi)
        return _DASH_ASIDE.match(text, n, hi) is not None or text[after : after + 1].isupper()
    if c.islower():
        return False
    if ";" in run or ";" in run:
        before = _seen_before(text, lo, at)
        return run[0] in ";;" and ("Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿")
    if "…" in run or ".." in run:
        before = _seen_before(text, lo, at)
        return not (before in PARTICLES and not before.isascii())
    if "!" in run or "?" in run:
        return gap or not c.isdigit()
    # one period
    if not gap:
        if c in _OPEN or c == '"':
            return not text[at - 1 : at].isdigit()
        if compound or not c.isupper():
            return False
    word = text[token:at].lstrip("“„«‘\"'([（「¿¡<").translate({ord(x): None for x in _INVISIBLE})
    if not gap:
        plain = word.replace("’", "").replace("'", "").replace("-", "")
        return len(plain) > 1 and plain.isalpha() and plain[-2:].islower() and _abbreviation(text, lo, at) is None and not _ADDRESS.match(text, n, hi)
    kind = _abbreviation(text, lo, at)
    if kind == "never":
        return False
    if kind in ("numbered", "month"):
        if c.isdigit() or c in "§(":
            return False
        if kind == "numbered" and len(word) == 1:
            return False
        return True
    if kind == "last":
        return True
    bare = word.strip("-’'")
    if len(bare) == 1 and bare.isalpha():
        return False
    if regex.fullmatch(r"(?:\p{L}\p{M}*\.)+\p{L}\p{M}*", bare):
        return False
    if bare.isdigit():
        if token <= _next(text, lo, hi):
            return False  # the number of a list item
        if len(bare) == 4 and bare[0] in "12":
            return True  # a year, no ordinal
        stop = token
        while stop > lo and text[stop - 1].isspace():
            stop -= 1
        space = _LAST_SPACE.search(text, lo, stop)
        before = text[space.end() if space else lo : stop]
        following = _WORD.match(text, n, hi)
        if following and (following.group().lower() in GERMAN_MONTHS or before.lower() in BEFORE_ORDINAL):
            return False
    return True


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each unit in code points, end exclusive; none for null, empty and blank texts.

    Units have no white space at either end and together cover all that is not white space.
    """
    spans: list[tuple[int, int]] = []
    if not text:
        return spans

    def emit(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            spans.append((a, b))

    at, levels = 0, _Levels()
    breaks = [(m.start(), m.end()) for m in _BLANK_LINE.finditer(text)] + [(len(text), len(text))]
    for stop, following in breaks:
        _paragraph(text, at, stop, emit, levels)
        at = following
    return spans


def _paragraph(text: str, lo: int, hi: int, emit, levels: _Levels) -> None:
    """Put out the units of a paragraph from its events; begin is where the open unit begins."""
    begin = _SPACE.match(text, lo, hi).end()
    if begin >= hi:
        return
    i, token, looked = begin, lo, lo
    for kind, p, end in _events(text, lo, hi):
        if end <= i and kind != _PAIR or p < i and kind in (_PAIR, _DASH, _LIST):
            continue
        p = max(p, i)
        if kind == _LIST:
            mark = _next(text, p, hi)
            # a level opens where a unit begins or after a colon, not inside a hard-wrapped sentence
            if levels.takes(text, p, end, _next(text, begin, hi) == mark or _seen_before(text, begin, p) in (":", "：")):
                emit(begin, p)
                begin, i = mark, end
                continue
            if text[end - 1] != ".":
                continue
            kind, p = _END, end - 1
        first = _next(text, begin, hi) == p  # nothing of the unit comes before
        if kind == _DASH:
            aside = _DASH_ASIDE.match(text, p, hi)
            if aside and first:
                i = begin = _close(text, begin, aside.end(), hi, emit)
            elif aside:
                i = aside.end()
            continue
        if kind == _PAIR:
            q = end
            i = q + 1
            if text[p] in _BRACKETS:
                if first and not _MARKER.fullmatch(text, p + 1, q):
                    i = begin = _close(text, begin, q + 1, hi, emit)
                continue
            inner = _seen_before(text, p + 1, q)
            if inner and (inner in _STRONG or inner in ".!?…;;"):
                while i < hi and text[i] in _CLOSE and text[i] != '"':
                    i += 1
                n = _next(text, i, hi)
                if n < hi and not _carries_on(text, n, hi):
                    emit(begin, i)
                    begin = i
            continue
        if text[p:end] in ("ครับ", "ค่ะ", "คะ"):
            emit(begin, end)
            i = begin = end
            continue
        # where the token of these terminators begins; each character is looked at once
        space = _LAST_SPACE.search(text, looked, p)
        compound = space is None and looked > max(lo, begin)
        token = max(space.end() if space else token, begin)
        looked = end
        while end < hi and text[end] in _CLOSE and text[end] != '"':
            end += 1
        if _ends(text, begin, p, end, hi, token, compound):
            emit(begin, end)
            begin = end
        i = end
    emit(begin, hi)


def _close(text: str, begin: int, end: int, hi: int, emit) -> int:
    """Emit an aside between sentences, with the terminators that touch it."""
    while end < hi and (text[end] in ".!?…" or text[end] in _STRONG):
        end += 1
    emit(begin, end)
    return end


def sentences(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence unit of every document.

    Offsets are code points from 0, end exclusive. Null, empty and blank texts give no rows;
    repeated documents give repeated rows. No shuffle; one text is held at a time.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                for a, b in sentence_spans(body.as_py()):
                    ids.append(key)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=batch.column(0).type), pa.array(starts, type=pa.int32()), pa.array(ends, type=pa.int32())], names=["doc_id", "start_char", "end_char"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start_char int, end_char int")
