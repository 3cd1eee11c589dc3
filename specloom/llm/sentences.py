"""Sentence boundaries in any language and script, as code point offsets.

A pushdown automaton runs once over the marks of each block of text. Its stack holds the open list levels, quotations and
brackets; what ends inside a quotation is undone when that closes, and stands if it never does. Abbreviations are found by
walking tries backwards from a point; scripts without blanks or capitals end at their own terminators. The time taken is linear
in the text. The language column is not used: it may be missing or wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.session import spread

#: fixed values: abbreviations that never end a sentence (titles, references, what always goes on)
NEVER = frozenset(
    """dr mr mrs ms prof st mt rev hon capt col gen lt sgt gov sen rep messrs fr vs viz cf eg e.g ie i.e approx ca circa resp incl excl fig figs tab vol vols ed eds ch chap sec pp pg pgs art par ver
    hr fr frl herr bzw vgl evtl ggf inkl exkl ca abb bd kap str tel z.b d.h u.a s.o s.u o.g i.d.r z.t sog
    mme mlle mm me p.ex ex env éd chap
    sr sra srta dra dña ud uds vd d.ª ee ej p.ej pág págs núm tel cap ref
    dhr mevr mw drs ir ing blz afb bijv o.a d.w.z m.b.t t.a.v nr nrs
    exmo exma eng
    см рис стр табл им ул гл ст проф акад тов т.е т.к т.н напр ср пр д-р г-н г-жа
    डॉ श्री श्रीमती पं द ص د أ م""".split()
)
#: fixed values: abbreviations that may end a sentence, if what follows can begin one
MAY = frozenset(
    """etc ltd corp inc co jr bros llc plc dept est a.m p.m am pm u.s u.k u.s.a e.u a.k.a d.c n.y al b.c a.d ph.d m.d kg km cm mm mhz khz min max sq
    usw usf etc co ag gmbh ing mio mrd jh
    s.a s.l s.r.l c.v n.v b.v a.g s.p.a uu ee.uu aprox m.n cía
    enz e.d jl
    тыс млн млрд руб коп др т.д т.п г гг в вв н.э кв""".split()
)
#: fixed values: abbreviations only before a number; else ordinary words
NUMBERED = frozenset(
    """no nos nr nos p pp s vol fig page jan feb mar apr may jun jul aug sep sept oct nov dec mär mrz mai okt dez
    ene abr ago dic janv févr avr juil août déc n núm núms art nº n.º zl abs
    янв фев мар апр авг сен сент окт ноя дек""".split()
)
#: fixed values: words before a number with a point that make it an ordinal
ORDINAL_BEFORE = frozenset("am der den dem des die das vom zum im beim ab seit bis jeder jeden ein einen einem zur ihr sein ihrem seinem".split())
#: fixed values: words that go on with a sentence; they are asked only where a text is all capitals
GOES_ON = frozenset(
    """a an and as at before after but by for from if in into is it of on or so than that then to until was were when which while who with you said asked
    auf aus bei bis das dem den der die für im in mit nach seit und von vor zu rief schrieb
    de du des dans en est et mais ou par pour que selon sur vers avec à disait
    con del desde dice en hasta para pero por que según sin y
    aan bij de het in met op te tot van voor en riep
    a ao com da de do em para por sem e disse
    в и из на от по с за до к о под при не но или сказал""".split()
)
#: fixed values: endings after which a blank ends a Thai sentence
THAI_END = ("ครับ", "ค่ะ", "คะ", "ครับผม", "นะคะ", "จ้ะ", "จ๊ะ", "ฮะ", "นะ", "ฯลฯ")

_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "„": "“”", "“": "”", "‚": "‘’", "‹": "›", '"': '"'}
_BRACKETS = frozenset("([{（［【〔")
_CLOSE = frozenset(")]}）］】〕」』》〉»”›")
_EMOTICON = r"(?:(?<=[\s.!?…。！？])(?:[:;=][-'^o]?[)(\]DPp|]|\^_+\^|[xX]D|<3)(?![\w(])|[☀-➿\U0001F000-\U0001FAFF]️?)"
_EVENT = re.compile(rf"(?P<emo>{_EMOTICON})|(?P<term>[.!?…。！？।॥؟۔｡．]+)|(?P<pair>[()\[\]{{}}（）［］【】〔〕「」『』《》〈〉«»„“”‚‹›\"])|(?P<thai>(?<=[฀-๿])\s+)")
_EMO_NEXT = re.compile(rf"\s*{_EMOTICON}")
_TOKEN_END = re.compile(r"[\s()\[\]\"'„“«»,;:!?/]")
_WORDS = re.compile(r"\w+")
_GLUED = re.compile(r"\w[\w'’-]*")
_BLANK = re.compile(r"\s*")
_BLOCK = re.compile(r"(?:[^\n]|\n(?![^\S\n]*(?:\n|\Z)))+")
_MARKER = re.compile(r"\n[^\S\n]*(?:(?P<bullet>[-*•◦▪‣·●○■□]+[^\S\n]+)|(?P<number>\(?(?:\d{1,2}|[a-z])\)[^\S\n]+|\d{1,2}\.[^\S\n]+))(?=\S)")
_WORD_BEFORE = re.compile(r"([\w.]+)[^\S\n]*\n?[^\S\n]*\Z")
_FIRST = re.compile(r"\s*\(?(\d{1,2}|[a-z])[.)]\s")
_WIDE = frozenset("。！？｡．")


def _begins(c: str) -> bool:
    """May `c` begin a sentence whatever came before? Capitals, digits, opening marks and letters without case may."""
    return c.isupper() or c.istitle() or c.isdigit() or c in "¿¡\"«„“‘'([{（［「『【《—–-*•#<_^:;" or (c.isalpha() and not c.islower()) or ord(c) > 0x2600


class Trie:
    """Words by their last letter first, each with a label; walked backwards from a place in a text."""

    def __init__(self, words: dict[str, str]):
        self.root: dict = {}
        for word, label in words.items():
            node = self.root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node[""] = label

    def longest(self, text: str, at: int, lo: int = 0) -> tuple[str | None, int]:
        """(label, start) of the longest word that ends before `at` and begins at `lo` or later; (None, at) if there is none."""
        node, found = self.root, (None, at)
        while True:
            if "" in node:
                found = (node[""], at)
            if at <= lo:
                return found
            for c in text[at - 1].lower():
                node = node.get(c)
                if node is None:
                    return found
            at -= 1

    def label(self, text: str, lo: int, at: int) -> str | None:
        """Label of exactly text[lo:at]."""
        label, start = self.longest(text, at, lo)
        return label if start == lo and at > lo else None


#: what a point after them means; a word of several kinds has the first that fits
_NUMBERED = Trie(dict.fromkeys(NUMBERED, "numbered"))
_ABBREVIATIONS = Trie(dict.fromkeys(NEVER, "never") | dict.fromkeys(MAY, "may"))
_ORDINAL = Trie(dict.fromkeys(ORDINAL_BEFORE, "ordinal"))
_THAI = Trie(dict.fromkeys(THAI_END, "end"))


@dataclass
class _Frame:
    """What is open: a list level ('list' with its last value), a quotation or a bracket with the marks that close it, and the
    state to return to when it closes."""

    kind: str
    at: int
    closers: str
    cuts: int
    start: int
    skip: int
    value: str = ""


class _Automaton:
    """Cuts one block of text. `stack` holds list levels below and quotations and brackets of the current item above them."""

    def __init__(self, text: str, out: list[tuple[int, int]]):
        self.text, self.out = text, out
        self.stack: list[_Frame] = []

    # list levels -----------------------------------------------------------------------------------------------------------
    def item(self, value: str) -> bool:
        """A line that begins with the number or letter `value`: is it the next item of an open list, or the first of a new
        one? Levels inside the one that goes on are closed."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].value == before_of(value):
                del self.stack[k + 1 :]
                self.stack[k].value = value
                return True
        if value in ("1", "a"):
            self.level(value)
            return True
        return False

    def level(self, value: str) -> None:
        self.stack.append(_Frame("list", 0, "", 0, 0, 0, value))

    # one item or stretch of running text -----------------------------------------------------------------------------------
    def run(self, lo: int, hi: int) -> None:
        self.lo, self.block = lo, self.text[lo:hi]
        block = self.block
        if _is_heading(block):
            self.out.append((lo + len(block) - len(block.lstrip()), lo + len(block.rstrip())))
            return
        self.n = n = len(block)
        self.cuts: list[tuple[int, int]] = []
        self.start, self.skip = _BLANK.match(block).end(), -1
        self.token_at = self.seen = 0
        self.base = len(self.stack)
        #: how many open frames each mark would close
        self.waiting: dict[str, int] = {}
        for e in _EVENT.finditer(block):
            kind, i = e.lastgroup, e.start()
            if kind == "pair":
                self.pair(e.group(), i)
            elif i >= self.skip and i >= self.start:
                if kind == "thai":
                    if _THAI.longest(block, i)[0]:
                        self.close(e.end())
                elif kind == "emo":
                    self.emoticon(e.end())
                elif not self.terminator(e):
                    break
        self.close(n)
        del self.stack[self.base :]
        self.out += [(lo + a, lo + b) for a, b in self.cuts]

    def close(self, end: int) -> None:
        """End the sentence before `end`; the next begins after the blanks."""
        block, e = self.block, end
        while e > self.start and block[e - 1].isspace():
            e -= 1
        if e > self.start:
            self.cuts.append((self.start, e))
        self.start = _BLANK.match(block, end).end()

    def pair(self, c: str, i: int) -> None:
        """An opening or closing mark. A mark closes the nearest open one that it fits, with all inside it; others say nothing."""
        block, straight = self.block, c == '"'
        opens = straight and i and block[i - 1].isspace() and i + 1 < self.n and not block[i + 1].isspace()
        if self.waiting.get(c) and not opens:
            while True:
                f = self.stack.pop()
                for x in f.closers:
                    self.waiting[x] -= 1
                if c in f.closers:
                    break
            del self.cuts[f.cuts :]
            self.start, self.skip = f.start, f.skip
            if f.at >= self.skip and f.at >= self.start:
                self.closed(f, i)
        elif c in _OPEN and not (straight and i and block[i - 1].isdigit()):
            closers = _OPEN[c]
            self.stack.append(_Frame("bracket" if c in _BRACKETS else "quote", i, closers, len(self.cuts), self.start, self.skip))
            for x in closers:
                self.waiting[x] = self.waiting.get(x, 0) + 1

    def closed(self, f: _Frame, shut: int) -> None:
        """A quotation or bracket has closed: does what follows begin a new sentence?"""
        block, skip = self.block, shut + 1
        self.skip = skip
        inner = shut
        while inner > f.at + 1 and block[inner - 1].isspace():
            inner -= 1
        if inner == f.at + 1 or block[inner - 1] not in ".!?…。！？।؟":
            return
        opened = self.start == f.at
        k = _BLANK.match(block, skip).end()
        if k >= self.n:
            return
        c = block[k]
        if f.kind == "bracket":
            if opened and _begins(c):
                self.close(skip)
        elif k > skip and not self.goes_on(skip, k) and (c.isalpha() and c.upper() != c.lower() or c.isdigit() or c in "¿¡([" or (c in '"«„“' and not opened)):
            if not (opened and block[f.at : skip].isupper()):
                self.close(skip)

    def emoticon(self, end: int) -> None:
        block = self.block
        k = _BLANK.match(block, end).end()
        if end < k < self.n and (_begins(block[k]) or block[k] in _OPEN) and not _EMO_NEXT.match(block, end):
            self.close(end)

    def terminator(self, e: re.Match) -> bool:
        """A run of terminators, with the marks it closes behind it. False at the end of the block."""
        block, n, i, end, mark = self.block, self.n, e.start(), e.end(), e.group()
        while end < n and block[end] in _CLOSE:
            end += 1
        if end < n and block[end] in "\"'’“" and (end + 1 >= n or block[end + 1].isspace()):
            end += 1
        while (m := _EMO_NEXT.match(block, end)) is not None:
            end = m.end()
        self.skip = max(self.skip, end)
        k = _BLANK.match(block, end).end()
        if k >= n:
            return True
        c = block[k]
        if mark[-1] in _WIDE:
            if c not in "、，,」』）)":
                self.close(end)
        elif k == end:
            # no blank follows: marks of scripts that need none end a sentence, others only where a blank was left out
            if mark[-1] in "।॥؟۔" and c.isalpha():
                self.close(end)
            elif c.isalpha() and len(mark) < 3 and end == e.end() and (m := _GLUED.match(block, k)) and any(x.isupper() for x in m.group()):
                if not (m.group().isupper() and (2 <= len(m.group()) <= 4 or not block[m.end() : m.end() + 1].isspace())):
                    lo = self.token(i)
                    if (i - lo > 2 or block[lo:i].isdigit()) and (mark != "." or self.ends_at_dot(i, c, False)) and "/" not in block[max(self.start, i - 12) : i] and not block[lo : lo + 3].lower().startswith("www"):
                        self.close(end)
        else:
            lower = self.goes_on(i, k)
            if c in ",;:)]}»”、，…" or (c in "—–" and block[k + 1 : k + 2].isspace()):
                pass
            elif (mark == "…" or mark.endswith("..")) and lower or mark == "." and not self.ends_at_dot(i, c, lower) or mark[-1] in ".…" and not (_begins(c) or c.islower()):
                pass
            else:
                self.close(end)
        return True

    def token(self, at: int) -> int:
        """Where the word before `at` begins. Places are asked for from left to right, so the text is gone over once."""
        if self.seen > at:
            self.token_at = self.seen = 0
        for m in _TOKEN_END.finditer(self.block, self.seen, at):
            self.token_at = m.end()
        self.seen = at
        return max(self.token_at, self.start)

    def goes_on(self, at: int, k: int) -> bool:
        """Does the text from `k` on read on after a point at `at` that may end the sentence? In all capitals only words can tell;
        a sentence of few words is not over yet."""
        block = self.block
        m = _WORDS.match(block, k)
        if m is None:
            return False
        w = m.group()
        if w[0].islower():
            # the rest of the block decides only whether it has capitals at all
            return not any(x.isupper() for x in w)
        if not w.isupper():
            return False
        capitals = words = 0
        inside = False
        for j in range(self.start, at):
            x = block[j]
            if x.islower():
                return False
            capitals += x.isupper()
            words += not x.isspace() and not inside
            inside = not x.isspace()
            if words > 3 and capitals >= 4 and j - self.start > 64:
                break  # a long stretch of capitals is enough to go by
        return capitals >= 4 and (w.lower() in GOES_ON or words <= 3)

    def ends_at_dot(self, at: int, after: str, lower: bool) -> bool:
        """Does the single point at `at` end the sentence? `after`: the next character that is no blank."""
        block, lo = self.block, self.token(at)
        while lo < at and block[lo] in "-.":
            lo += 1
        if lo == at:
            return True
        size = at - lo
        # of a very long word only its end matters
        word = block[max(lo, at - 64) : at].lower()
        m = _WORD_BEFORE.search(block[max(0, lo - 14) : lo])
        before = m.group(1).lower() if m else ""
        if after.isdigit() and _NUMBERED.label(block, lo, at):
            return False
        if word == "г":  # a year's mark may end a sentence, a town's never
            return bool(before) and before[-1].isdigit() and not lower
        if word == "ee" or (word == "co" and block[at + 1 : at + 8].lstrip().lower().startswith(("ltd", "inc", "kg"))):
            return False
        label, begins = _ABBREVIATIONS.longest(block, at, lo)
        if label and begins == lo:
            return label == "may" and not lower
        if label == "may" and block[begins - 1] == "-":
            return not lower
        token = block[lo:at] if size <= 64 else word
        if size == 1 and token.isalpha():
            if token.isupper() and before[-1:].isdigit():  # 15 A. is a measure
                return True
            return not (token.isupper() or lower or after.isdigit() or token in "pszdhbuot") if token.isascii() else not (lower or token.isupper())
        if word.isdigit():
            if self.start >= lo and size <= 3:  # '2. Memory'
                return False
            return not (size <= 2 and _ORDINAL.label(before, 0, len(before)))
        if "." in token and lower:  # x.y. in the middle
            return token.rpartition(".")[2].isdigit()
        return not (lower and size <= 4 and word.isascii() and word.isalpha() and not re.search("[aeiouy]", word))


def _is_heading(block: str) -> bool:
    """One short line without a final terminator, of which a point follows a number or a single letter only."""
    s = block.strip()
    return "\n" not in s and len(s) <= 48 and s[-1] not in '.!?…。！？।؟"”»' and len(s.split()) <= 7 and re.search(r"(?:^|\s)(?:\d+|[A-Z])\.\s", s) is not None


def before_of(value: str) -> str:
    """The number or letter before `value` in a counted list."""
    return str(int(value) - 1) if value.isdigit() else chr(ord(value) - 1)


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Half-open code point ranges of the sentences of one text, in order, without white space around them. Null, empty and
    blank texts have none."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for block in _BLOCK.finditer(text):
        lo, hi = block.span()
        if not block.group().strip():
            continue
        machine = _Automaton(text, out)
        at, block = lo, text[lo:hi]
        if (first := _FIRST.match(block)) is not None:
            machine.level(first.group(1))
        body = "\n" + block.lstrip("\n") if text[lo] == "\n" else block
        shift = hi - len(body)
        for m in _MARKER.finditer(body):
            if m.group("number"):
                # a wrapped line may begin with a number too: items of a list are counted from one
                end = m.start()
                while end and body[end - 1].isspace():
                    end -= 1
                if not end or body[end - 1] not in ".!?:;…。！？" or not machine.item(m.group("number").strip("(). \t")):
                    continue
            c = shift + m.start()
            if c > at and not text[at:c].isspace():
                machine.run(at, c)
            at = c
        if hi > at and not text[at:hi].isspace():
            machine.run(at, hi)
    return out


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_pos, end_pos) of every sentence of every text; whole texts, one pass, no exchange of large inputs.

    Rows that repeat an id give their sentences once per row. Columns of `df` other than the two are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).type
            ids: list = []
            starts: list[int] = []
            ends: list[int] = []
            for k in range(batch.num_rows):
                spans = sentence_spans(batch.column(1)[k].as_py())
                ids += [batch.column(0)[k].as_py()] * len(spans)
                for a, b in spans:
                    starts.append(a)
                    ends.append(b)
                if len(ids) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "start_pos", "end_pos"])
                    ids, starts, ends = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "start_pos", "end_pos"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")))
    return rows.mapInArrow(run, f"id {kind}, start_pos int, end_pos int").withColumnRenamed("id", id_col)
