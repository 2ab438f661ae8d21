"""Sentence units of documents in any language, script and layout.

A pushdown automaton runs over each whole text. Its stack holds the open quotations and brackets, its block
state the level of the layout (heading, list item, form line, speaker's turn, wrapped paragraph). It reads only
the characters at which something can happen: terminators, quotes, brackets and, in scripts without terminators,
blanks. Abbreviations are looked up in a trie read backwards from the full stop.

Defined cases: null, empty and blank texts give no unit; a text without any terminator is one unit a block;
an unmatched quote or bracket is ordinary text; repeated texts and rows give their units once a row; columns
besides the key and the text are not looked at and may have any names; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import map_arrow, spread

# --- abbreviations ------------------------------------------------------------------------------------------

#: Words after whose full stop a sentence goes on, whatever follows.
BOUND = (
    "dr mr mrs ms prof st mt capt lt sgt messrs "
    "vs approx ca cf eg ie viz resp incl excl bzw evtl ggf vgl bspw sog hrsg "
    "env mme mlle dra sra srta aprox núm pág págs gral "
    "стр рис см им ул проф г-жа г-н д р د أ م डॉ श्री रु प्रो"
).split()
#: Words after whose full stop a sentence goes on where a number follows.
NUMBERED = "no nr nos p pp s fig figs sec secs vol ch eq abb abs tab tel art cap col bd n num pos bl z".split()
#: Words which may end a sentence: what follows decides.
OPEN = (
    "etc inc co ltd corp jr sr al rd ave blvd dept assn bros usw ff bldg ste sq "
    "jan feb mar apr jun jul aug sep sept oct nov dec mo tu we th fr sa "
    "г гг руб коп тыс млн др пр т"
).split()
#: Of these, the ones before a day or year.
MONTHS = "jan feb mar apr jun jul aug sep sept oct nov dec".split()
#: What follows a time of day or a state without a new sentence beginning.
CARRIED = frozenset(
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday Mondays Tuesdays Wednesdays Thursdays Fridays Saturdays Sundays "
    "January February March April May June July August September October November December EST EDT CET GMT UTC PST "
    "Army Navy Senate Congress Government President Department Treasury Supreme Court Constitution".split()
)
GERMAN_MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Klasse Auflage Stock".split())


class Trie:
    """Words stored from their last character on, each with a mark."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, mark: str) -> None:
        node = self.root
        for char in reversed(word):
            node = node.setdefault(char, {})
        node[""] = node.get("", "") + mark

    def look(self, text: str, end: int) -> str:
        """The marks of the whole word that ends before `end`, or nothing."""
        node, i = self.root, end - 1
        while i >= 0 and (step := node.get(text[i].lower())) is not None:
            node, i = step, i - 1
        if "" in node and (i < 0 or not (text[i].isalnum() or text[i] in "-'’_.")):
            return node[""]
        return ""


ABBREVIATIONS = Trie()
for _words, _mark in ((BOUND, "b"), (NUMBERED, "n"), (OPEN, "o"), (MONTHS, "m")):
    for _word in _words:
        ABBREVIATIONS.add(_word, _mark)

# --- layout -------------------------------------------------------------------------------------------------

LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
MARKER = re.compile(r"(?:[•◦▪●·‣⁃]\s*|[*+–—-][ \t ]+|\(?\d+[.)、][ \t ]+|\(?[A-Za-z][)][ \t ]+|[①-⑳]\s*)")
NUMBER_MARKER = re.compile(r"\(?\d+[.)、]")
HEADING = re.compile(r"#{1,6}[ \t ]|={2,}|\d+(?:\.\d+)+[ \t ]+\S[^.!?。！？]*$")
#: A label: few words, a capital or a caseless letter first, no digit or mark inside, and after the colon no quotation.
LABEL = re.compile(r"(?![a-zа-яß-ÿ])([^\W\d_][^\s\d:：,，.。;；!?！？()（）\"“”„«»]*(?:[ \t  ][^\s\d:：,，.。;；!?！？()（）\"“”„«»]+){0,2})[   ]?[:：](?![/\\])[ \t  　]*(?=([^\s\"“”„«»「『’'])|$)?")
CAPTION = re.compile(r".*[:：]\s*$")
#: Characters of scripts without blanks, in which a label is a few characters instead of a few words.
UNSPACED, FEW = re.compile(r"[぀-ヿ㐀-鿿฀-໿]"), 24

# --- characters ---------------------------------------------------------------------------------------------

STOPS = "。！？｡．"
OTHER_STOPS = "।॥؟۔።᙮។៕။"
TERMINATORS = ".!?…‼⁇⁈⁉" + STOPS + OTHER_STOPS
PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "“": "”", "„": "“", "«": "»", "‹": "›", "〈": "〉", '"': '"', "＂": "＂"}
CLOSERS = frozenset(PAIRS.values())
BRACKETS = frozenset("(（[【〔")
EVENT = re.compile("[" + re.escape(TERMINATORS) + "]+|[" + re.escape("".join(PAIRS) + "".join(CLOSERS - {'"', "＂"})) + "]")
THAI = re.compile(r"[฀-໿]")
THAI_GAP = r"(?<=[฀-໿\d%])[ \t 　\n\r]+(?=[ก-ฮเ-ไກ-ໟ])"
THAI_EVENT = re.compile(EVENT.pattern + "|" + THAI_GAP)
#: Words with which a Thai sentence goes on after a blank.
THAI_ON = re.compile(r"(?:ๆ|ฯ|ของ|และ|หรือ|ถึง|กับ|ที่|ซึ่ง|ใน|เป็น|คือ|แต่|จุด|บาท|เปอร์เซ็นต์|ด้วย|อยู่|คน|ครั้ง|ปี|เมตร|กรัม|กิโล|หน้า|น\.|แล้ว|จาก|โดย|เพื่อ|ว่า|ให้|ก็|ไป|มา|รวม)")
#: Words with which a sentence goes on after a quotation that ends with its own terminator.
CJK_ON = re.compile(r"(?:然后|然後|随后|於是|接着|接著|并|並|后|後|就|便|的|地|得|说|說|问|問|道|喊|叫|答|と|は|が|を|に|で|も|の|や|って|라고|고|는|은|이|가|를|을)")
DASHES = "—–-―"


def _kinds(text: str) -> list[tuple[int, int, str]]:
    """The lines with their kind: blank, list, head, label or plain."""
    lines: list[tuple[int, int, str]] = []
    start = 0
    cuts = [(m.start(), m.end()) for m in LINE_END.finditer(text)]
    before = "blank"
    said = ""
    for end, after in [*cuts, (len(text), len(text))]:
        line = text[start:end].strip()
        if not line:
            kind = "blank"
        elif MARKER.match(line) and (before != "plain" or CAPTION.fullmatch(said) or not NUMBER_MARKER.match(line)):
            kind = "list"
        elif HEADING.match(line) and before in ("blank", "head"):
            kind = "head"
        elif (m := LABEL.match(line)) and (m.end() == len(line) or m.group(2)) and (len(m.group(1)) <= FEW or not UNSPACED.search(m.group(1))) and not (m.end() == len(line) and before == "plain" and not CAPTION.fullmatch(said)):
            kind = "label" if m.end() < len(line) else "head"
        else:
            kind = "plain"
        lines.append((start, end, kind))
        before, said, start = kind, line, after
    return lines


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Stretches within which units lie, and whether a list marker begins them."""
    start = None
    lines = _kinds(text)
    last = 0
    for at, (begin, end, kind) in enumerate(lines):
        if kind == "blank":
            if start is not None:
                yield start, last, False
                start = None
        elif kind == "plain":
            after = lines[at + 1][2] if at + 1 < len(lines) else "blank"
            if start is None:
                start = begin
            last = end
            if after not in ("plain", "blank"):
                yield start, end, False
                start = None
        else:
            if start is not None:
                yield start, last, False
                start = None
            yield begin, end, kind in ("list", "head")
    if start is not None:
        yield start, last, False


def _pairs(text: str, events: list[re.Match]) -> dict[int, int]:
    """Opening position to closing position of every matched quotation and bracket; what has no partner is left out."""
    stack: list[tuple[str, int]] = []
    found: dict[int, int] = {}
    waiting = dict.fromkeys(CLOSERS, 0)  # how often each closing mark is waited for, so that no search is in vain

    def close(mark: str, at: int) -> None:
        while True:  # what was opened within and never closed is ordinary text
            char, begun = stack.pop()
            waiting[char] -= 1
            if char == mark:
                if at >= 0:
                    found[begun] = at
                return

    for m in events:
        char, at = m.group()[0], m.start()
        if char in TERMINATORS or char.isspace():
            continue
        open_ = waiting.get(char, 0) > 0
        if char in '"＂' and open_ and at + 1 < len(text) and not text[at + 1].isspace() and (at == 0 or text[at - 1].isspace()) and text[at + 1].isalnum():
            close(char, -1)  # a second opening mark: the first one was never closed
            open_ = False
        if open_:
            close(char, at)
        elif char in PAIRS:
            stack.append((PAIRS[char], at))
            waiting[PAIRS[char]] += 1
        elif char == "”" and waiting["“"]:  # „ … ” as some keyboards have it
            close("“", at)
    return found


class Word:
    """The word that is being read: where it begins and what is in it; carried along, so that no character is looked at twice."""

    def __init__(self, text: str, at: int) -> None:
        self.text, self.begin, self.read = text, at, at
        self.path = self.dotted = False

    def to(self, at: int) -> None:
        text = self.text
        for k in range(at - 1, self.read - 1, -1):
            if text[k].isspace():
                self.begin, self.path, self.dotted = k + 1, False, False
                self.read = k + 1
                break
        self.path |= text.find("/", self.read, at) >= 0 or text.find("@", self.read, at) >= 0
        self.dotted |= text.find(".", self.read, at) >= 0
        self.read = max(at, self.read)


def _cjk(char: str) -> bool:
    return "぀" <= char <= "ヿ" or "㐀" <= char <= "鿿" or "가" <= char <= "힯"


def _word(text: str, at: int, end: int) -> str:
    stop = at
    while stop < end and (text[stop].isalnum() or text[stop] in "'’-"):
        stop += 1
    return text[at:stop]


def _begins(text: str, at: int, end: int) -> str:
    """How the text from `at` on looks: end, upper, lower, digit, cjk, caseless or other."""
    while at < end and (text[at].isspace() or text[at] in DASHES or text[at] in "¿¡" or text[at] in PAIRS or text[at] in "'‘*_~"):
        at += 1
    if at >= end:
        return "end"
    char = text[at]
    if char.isdigit():
        return "digit"
    if _cjk(char):
        return "cjk"
    if char.isupper() or char.istitle():
        return "upper"
    if char.islower():
        return "lower"
    return "caseless" if char.isalpha() else "other"


def _full_stop(text: str, start: int, dot: int, after: int, end: int) -> bool:
    """Whether one full stop at `dot` ends a sentence; `after` is where what follows begins, closers left out."""
    begin = dot
    while begin > start and not text[begin - 1].isspace() and text[begin - 1] not in PAIRS:
        begin -= 1
    word = text[begin:dot]
    if not word:
        return dot > start and _begins(text, after, end) == "upper"
    nxt = _begins(text, after, end)
    if nxt == "end":
        return True
    at = after
    while at < end and (text[at].isspace() or text[at] in PAIRS):
        at += 1
    follows = _word(text, at, end)
    marks = ABBREVIATIONS.look(text, dot)
    if "m" in marks:
        return nxt in ("upper", "cjk")
    if "n" in marks and (nxt == "digit" or "b" in marks or "o" in marks):
        return False
    if "n" in marks and len(word) == 1:
        return False
    if "b" in marks:
        return False
    if "o" in marks:
        return nxt in ("upper", "digit", "cjk") or (nxt == "lower" and _hyphened(follows))
    if "." in word and re.fullmatch(r"(?:[^\W\d_]{1,3}\.)+[^\W\d_]{1,3}", word):
        if word.lower() in ("i.e", "e.g", "z.b", "d.h", "u.a", "p.ex", "т.е"):
            return False
        return (nxt in ("upper", "digit", "other") or _hyphened(follows)) and follows not in CARRIED
    letters = word.lstrip("\"'‘“„«(")
    if len(letters) == 1 and letters.isalpha() and not _cjk(letters):
        return False  # an initial
    if word.isdigit() and nxt == "upper" and follows in GERMAN_MONTHS and text[dot + 1 : dot + 2].isspace():
        return follows in ("April", "August", "September", "November") and not _german(text, start, begin)
    if nxt == "lower":
        return (len(letters) >= 3 and letters[-1].isalpha() and not word[0].isdigit()) or _hyphened(follows)
    return True


def _hyphened(word: str) -> bool:
    return len(word) > 2 and word[1] == "-" and word[0].islower()


def _german(text: str, start: int, end: int) -> bool:
    return re.search(r"\b(?:der|die|das|dem|den|am|vom|im|ab|bis|zum|gilt)\b", text[max(start, end - 40) : end]) is not None


def _gap_is_wide(text: str, at: int, end: int) -> bool:
    return at >= end or text[at].isspace()


def cut_block(text: str, start: int, end: int, marked: bool) -> list[int]:
    """Ends of the units of one block, without the block's own end."""
    thai = THAI.search(text, start, end) is not None
    events = list(THAI_EVENT.finditer(text, start, end) if thai else EVENT.finditer(text, start, end))
    skip = start
    if marked:
        head = start
        while head < end and text[head].isspace():
            head += 1
        if m := MARKER.match(text, head, end) or re.compile(r"\d+(?:\.\d+)*\.?\s").match(text, head, end):
            skip = m.end()
    pairs = _pairs(text, [m for m in events if m.start() >= skip]) if any(m.group()[0] not in TERMINATORS for m in events) else {}
    ends: list[int] = []
    since = start  # where the unit being read begins
    stack: list[tuple[int, int, bool]] = []  # opening, closing, whether it begins its unit
    spoken = 0  # the end of the last terminator inside the stack
    resume = skip
    word = Word(text, start)
    for m in events:
        at, stop, run = m.start(), m.end(), m.group()
        word.to(at)
        if at < resume:
            continue
        if run[0].isspace():
            if not stack and _thai_ends(text, start, at, stop):
                ends.append(at)
                since = resume = stop
            continue
        if run[0] not in TERMINATORS:
            if at in pairs:
                stack.append((at, pairs[at], not text[since:at].strip(" \t\n\r  　*_#")))
                continue
            if not stack or stack[-1][1] != at:
                continue
            opened, _, first = stack.pop()
            if stack:
                continue
            inside = text[opened + 1 : at].rstrip()
            # further closers and terminators belong to what they close
            tail = stop
            while tail < end and (text[tail] in CLOSERS and tail not in pairs):
                tail += 1
            if tail < end and text[tail] in TERMINATORS:
                continue  # the next event decides
            if not inside or spoken != opened + 1 + len(inside):
                continue
            if _after_group(text, run, opened, first, inside, since, tail, end):
                ends.append(tail)
                since = resume = tail
            continue
        if stack:
            spoken = stop
            continue
        tail = stop
        while tail < end and text[tail] in CLOSERS and tail not in pairs and text[tail] not in '"＂':
            tail += 1
        if _after_stop(text, run, since, at, stop, tail, end, word):
            ends.append(tail)
            since = resume = tail
    return ends


def _after_stop(text: str, run: str, since: int, at: int, stop: int, tail: int, end: int, word: Word) -> bool:
    if tail >= end:
        return True
    mark = run[-1]
    if any(c in STOPS or c in OTHER_STOPS for c in run):
        return not (run[-1] == "．" and text[tail].isdigit())
    nxt = text[tail]
    if nxt in ",，;；:：、":
        return False
    if "…" in run or run.startswith("..."):
        if not nxt.isspace() and not _cjk(nxt) or _cjk(nxt):
            return False
        kind = _begins(text, tail, end)
        return kind in ("upper", "digit") or kind in ("cjk", "caseless") and at > 0 and not text[at - 1].isspace()
    if mark in "!?‼⁇⁈⁉":
        if not nxt.isspace():
            return _cjk(nxt) or _glued(text, at, tail, word)
        if _dash_first(text, tail, end):
            return False
        kind = _begins(text, tail, end)
        return kind != "lower" or _hyphened(_next_word(text, tail, end))
    if not nxt.isspace():
        if _cjk(nxt):
            return not text[at - 1 : at].isdigit() and not text[at - 1 : at].isascii()
        return len(run) == 1 and _glued(text, at, tail, word)
    if len(run) > 1:
        return _begins(text, tail, end) in ("upper", "digit")
    return _full_stop(text, since, at, tail, end)


def _glued(text: str, at: int, tail: int, word: Word) -> bool:
    """A lost blank: a small letter, digit or mark before the terminator and a capitalised word, or an opening mark, right after it."""
    before, nxt = text[at - 1 : at], text[tail]
    if nxt in PAIRS:
        return nxt not in BRACKETS and (before.islower() or before in '%)"”»') or nxt in "(（" and before.islower()
    if nxt in "¿¡":
        return True
    if not nxt.isupper() or not (text[tail + 1 : tail + 2].islower() or (text[tail + 1 : tail + 2].isspace() and nxt in "AIÀÉЯВУОК")):
        return False
    if ABBREVIATIONS.look(text, at) and "b" in ABBREVIATIONS.look(text, at):
        return False
    if word.path or text.startswith("www", word.begin):
        return False
    return before.islower() or before.isdigit() or before in "%)\"”»'" or word.dotted or not before.isascii()


def _dash_first(text: str, at: int, end: int) -> bool:
    """A dash and then a small letter: the words that say who asked."""
    while at < end and text[at].isspace():
        at += 1
    return at < end and text[at] in DASHES and _begins(text, at, end) == "lower"


def _next_word(text: str, at: int, end: int) -> str:
    while at < end and text[at].isspace():
        at += 1
    return _word(text, at, end)


def _after_group(text: str, run: str, opened: int, first: bool, inside: str, since: int, tail: int, end: int) -> bool:
    """Whether a unit ends after a quotation or bracket whose own last character is a terminator."""
    if tail >= end:
        return True
    nxt = text[tail]
    if nxt in ",，;；:：、":
        return False
    bracket = text[opened] in BRACKETS
    if bracket and first:
        return True
    if inside.endswith((".", "…")) and bracket and _begins(text, tail, end) == "lower":
        return False
    at = tail
    while at < end and text[at].isspace():
        at += 1
    if at >= end:
        return True
    said = text[since:opened].rstrip()
    told = said.endswith((":", "：", ",", "，"))
    kind = _begins(text, at, end)
    if text[at] in DASHES:
        return kind in ("upper", "digit") and told
    if kind == "cjk" or (kind in ("digit", "upper", "other") and (_cjk(inside[0]) or inside[-1] in STOPS)):
        if first and not bracket:
            return False
        return not CJK_ON.match(text, at) and (told or bracket)
    if kind == "caseless" or (kind in ("digit", "upper") and inside[-1] in OTHER_STOPS):
        return told and not first
    if kind == "lower":
        return _hyphened(_word(text, at, end)) and told
    if kind == "other":
        return told
    return True


def _thai_ends(text: str, start: int, at: int, stop: int) -> bool:
    """Whether a blank closes a sentence of Thai or Lao; one within a sentence stands beside numbers, names and repeat marks."""
    if text[at - 1] in "ๆฯ" or THAI_ON.match(text, stop):
        return False
    before = text[max(start, at - 20) : at]
    return not before[-1].isdigit() or re.search(r"(?:ถึง|ปี|หน้า|ที่)[  ]*\d+$", before) is not None or re.search(r"(?:^|\s)\d{4}$", before) is not None


def units(text: str | None) -> list[tuple[int, int]]:
    """Offsets of the sentence units of a text, in code points, the end exclusive."""
    if not text or text.isspace():
        return []
    found: list[tuple[int, int]] = []
    for start, end, marked in blocks(text):
        begin = start
        for stop in [*cut_block(text, start, end, marked), end]:
            a, b = begin, stop
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if b > a:
                found.append((a, b))
            begin = stop
    return found


def _batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, starts, ends = [], [], []
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for a, b in units(text):
            ids.append(key)
            starts.append(a)
            ends.append(b)
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start_char", "end_char"])


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per unit: doc_id, start_char, end_char. Narrow: no shuffle beyond spreading a small scan."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") > 0))
    return map_arrow(spread(rows), _batch, "doc_id long, start_char long, end_char long")
