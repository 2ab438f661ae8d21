"""Broken prompt and response pairs.

The clauses of every response that has content are tagged by one conditional random field as answer, refusal, echo,
foreign or unfinished; the share of the response that each tag covers makes the defect of the pair. A clause's words are
read once and kept by their wording; what depends on the pair (overlap with the prompt, language against the prompt's,
the close of the response as the truncation operator reads it) is added.

The field learns from a bounded sample without labels, in two steps. Refusals are composed (refusals.py), prompts given
back, responses moved to prompts of another language and responses cut short are made from the sample; answers are
first only the clauses that carry what a refusal has not: numbers, names, quotations, words that other responses quote.
The field so learned tags the whole sample, and is learned again with the tags it is sure of, twice.

Exact checks follow where the definition is exact: a tagged copy is one if nothing but the prompt is left of it, an
unfinished response if the truncation operator finds it, a foreign one if its language is nearer as a whole.

Defined cases: a null response is an empty one; a pair has at most one defect, the first of empty, copied,
truncated, refusal and wrong language; without a prompt (null, blank or none found) only empty, truncated and
refusal occur; redelivered rows count each; a prediction's prompt is that of the question with the lowest
record_id; numbers and names are in no language; empty tables give no rows.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import truncation
from tesserae.llm.common import language, spread
from tesserae.llm.crf import MASK, ChainCRF
from tesserae.llm.languages import QUOTED, Languages
from tesserae.llm.refusals import PARTS, SPOKEN, composed

#: Bound of the sample of pairs that the field is learned from.
SAMPLE = 9000
#: Texts a language, and composed refusals a language.
PER_LANGUAGE, COMPOSED = 1600, 500
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
#: Log-odds that the truncation operator's finding adds to the label unfinished, and within which an unsure response is not learned from.
CUT_ODDS, UNSURE = 8.0, 4.0
#: Log-likelihood by which a whole response must be nearer to another language than to the prompt's.
MARGIN = 4.0

CLAUSE = re.compile(r"(?<=[.!?;])[\"”»)]*\s+|(?<=[。！？；])[”」）]?|\n+")
DIGITS = re.compile(r"\d+")
CONTENT = re.compile(r"[^\W_]")
QUOTE = re.compile(r"[“„«「『\"]")
#: Capitalised words within a sentence: names, and in German nouns.
INNER = re.compile(r"(?<=[a-zß-ÿ,;:] )[A-ZÀ-ÝА-Я][a-zß-ÿа-я]{2,}\b")
WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
WRAPPER = re.compile(
    r"<img>.*?</img>|</?(?:image|video|img|ref|answer|question)>|^[\W_]*(?:q|a|question|answer|you asked|the question was|prompt|frage|antwort|pregunta|respuesta|réponse|问题|問題|质问|質問|回答|答案|问|答)\s*[:：]|\b(?:answer|a|antwort|respuesta|réponse|回答|答案)\s*[:：]\s*$|^\s*look at the image and reply\.|\breply with one short phrase\.?\s*$",
    re.S | re.I,
)
#: Prompts for a language.
NAMED = {
    "en": r"english|englisch|anglais|inglés|英文|英语|英語",
    "de": r"german|deutsch|allemand|alemán|德文|德语|ドイツ語",
    "fr": r"french|französisch|français|francés|法文|法语|フランス語",
    "es": r"spanish|spanisch|espagnol|español|西班牙文|西班牙语|西语|スペイン語",
    "zh": r"chinese|chinesisch|chinois|chino|中文|汉语|中国語",
    "ja": r"japanese|japanisch|japonais|japonés|日文|日语|日本語",
    "ru": r"russian|russisch|russe|ruso|俄文|俄语|ロシア語",
    "ar": r"arabic|arabisch|arabe|árabe|阿拉伯文|阿拉伯语|アラビア語",
}
INNER_PROMPT = re.compile(r"(?<=[a-zß-ÿ,;:] )(?!(?:Engl|Germ|Fren|Span|Chin|Japan|Russ|Arab|Deut|Franz))[A-ZÀ-ÝА-Я][a-zß-ÿа-я]{2,}\b")
ASKED = {c: re.compile(rf"\b(?:in|into|auf|en|to|al|ins?|vers)\s+(?:{p})\b|[用成译為为](?:{p})|(?:{p})で", re.I) for c, p in NAMED.items()}
ANY_ASKED = re.compile("|".join(NAMED.values()), re.I)
#: Prompts for the words seen in a picture.
READ = re.compile(
    r"\bwhat (?:is|’s|'s) (?:written|said|printed)|\bwhich words|\bwhat words|\bread the (?:text|words|sign)|\bthe sign\b.*\bsay|\bsaid by the sign|\bsign .*\bsays?\b|\btranscribe|\bwhat does .* (?:say|read)\b|\bbrand\b"
    r"|\bwas steht|\blies\b.*\btext|\bsteht auf\b|\bque dit\b|\blis\b.*\btexte|\bécrit|\bqu[eé] dice|\blee\b.*\btexto|\bqu[eé] (?:pone|está escrito)|\btexto\b.*\bletrero"
    r"|写[了着的]|寫[了著的]|文字|什么字|何と書|書いて|読んで|读出|讀出|念出",
    re.I | re.S,
)
def normal(text: str) -> str:
    """Letters and digits of a text, whatever their case and width."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def bare(text: str) -> str:
    """A prompt or response without wrapper, case, width, punctuation and blanks."""
    text = unicodedata.normalize("NFKC", text)
    for _ in range(3):
        less = WRAPPER.sub(" ", text).strip().strip("\"“”'")
        if less == text:
            break
        text = less
    return "".join(c for c in text.casefold() if c.isalnum())


def _near(a: str, b: str, most: int) -> bool:
    """Edit distance of at most `most`, by the diagonals that far off."""
    if abs(len(a) - len(b)) > most:
        return False
    reach = {0: 0}
    for spent in range(most + 1):
        for k, i in list(reach.items()):
            j = i + k
            while i < len(a) and j < len(b) and a[i] == b[j]:
                i, j = i + 1, j + 1
            reach[k] = i
        if reach.get(len(b) - len(a), -1) >= len(a):
            return True
        wider: dict[int, int] = {}
        for k, i in reach.items():
            for k2, i2 in ((k, i + 1), (k + 1, i), (k - 1, i + 1)):
                if i2 <= len(a) and i2 + k2 <= len(b):
                    wider[k2] = max(wider.get(k2, -1), i2)
        reach = wider
    return False


def copied(prompt: str, response: str) -> bool:
    """Whether a response gives back the prompt and nothing else, however written and however often."""
    q, a = bare(prompt), bare(response)
    if not q or not a or len(q) < 3:
        return False
    times = max(1, round(len(a) / len(q)))
    if a == q * times:
        return True
    return len(q) >= 6 and _near(a, q * times, times * (1 if len(q) < 12 else 2))


# --- clauses ------------------------------------------------------------------------------------------------


def clauses(text: str) -> list[str]:
    """Clauses of a response; a text within quotation marks is not broken."""
    parts = [q for p in CLAUSE.split(text) if (q := p.strip())]
    if len(parts) < 2:
        return parts
    quoted = QUOTE.search(text) is not None
    out = [parts[0]]
    for p in parts[1:]:
        if quoted and _opened(out[-1]) or not CONTENT.search(p):
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def plain(text: str) -> str:
    """A response with its numbers and names left open."""
    return INNER.sub("X", DIGITS.sub("0", text))


def _opened(text: str) -> bool:
    """Whether a quotation is still open at the end of a text."""
    for a, b in (("“", "”"), ("«", "»"), ("「", "」")):
        if a in text and text.rfind(a) > text.rfind(b) and not (a == "“" and "„" in text):
            return True
    if "„" in text and text.rfind("„") > max(text.rfind("“"), text.rfind("”")):
        return True
    return '"' in text and text.count('"') % 2 == 1


_KNOWN: dict[str, int] = {}


def _hash(features: list[str]) -> list[int]:
    """Rows of features in the field's table; what is seen again is not hashed again."""
    out = []
    for f in features:
        if (at := _KNOWN.get(f)) is None:
            if len(_KNOWN) >= 200_000:
                _KNOWN.clear()
            at = _KNOWN[f] = crc32(f.encode("utf-8", "surrogatepass")) & MASK
        out.append(at)
    return out


def wording(clause: str) -> list[str]:
    """Features of a clause's own words, outside quotations."""
    said = QUOTED.sub(" “” ", clause) if QUOTE.search(clause) else clause
    words = WORD.findall(said.casefold())
    found = [*words, *map(" ".join, zip(words, words[1:], strict=False)), *(w[:4] + "*" for w in words if len(w) > 4), "^" + " ".join(words[:2]), f"size{min(len(words), 8)}"]
    if said is not clause:
        found.append("quoted")
    if "0" in clause:
        found.append("number")
    if "X" in clause:
        found.append("name")
    return found


def grounded(response: str) -> bool:
    """Whether a response carries what a refusal has not: a number, a quotation or a name (a noun, in German) that refusals have no use for."""
    return DIGITS.search(response) is not None or QUOTED.search(response) is not None or any(m.casefold() not in SPOKEN for m in INNER.findall(response))


NO_PROMPT = (-1, False, frozenset(), (), frozenset())


class Tagger:
    """The field, the languages and the truncation weights; of fixed size and carried to the tasks."""

    #: Wordings kept per task before the store is emptied.
    KEPT = 100_000

    def __init__(self, field: ChainCRF, languages: Languages, cut: np.ndarray) -> None:
        self.field, self.languages, self.cut = field, languages, cut
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[list[float], list[float]]] = {}
        self.prompts: dict[str, tuple] = {}
        self.contexts: dict[tuple, list[float]] = {}
        self.step = self.field.step.tolist()
        self.begin = self.field.begin.tolist()
        # what a path can gain, a clause, by leaving the label answer: two other steps, or another beginning
        self.bound = 2 * float(self.field.step.max() - self.field.step[ANSWER, ANSWER]) + float(self.field.begin.max() - self.field.begin[ANSWER])

    def __getstate__(self):
        return self.field, self.languages, self.cut

    def __setstate__(self, state):
        self.__init__(*state)

    def clause(self, key: str) -> tuple[list[float], list[float]]:
        """Emission and language scores of a clause's own words."""
        if (kept := self.known.get(key)) is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            outside = QUOTED.sub(" ", key) if QUOTE.search(key) else key
            kept = self.known[key] = (
                self.field.emit[_hash(wording(key))].sum(axis=0).tolist(),
                self.languages.scores(outside if sum(map(str.isalpha, outside)) >= 4 else key),
            )
        return kept

    def prompt(self, text: str | None) -> tuple[int, bool, frozenset[int], tuple[str, ...], frozenset[str]]:
        """Language of a prompt (-1: none), whether it asks for words seen, languages it asks for, pieces of it, its words."""
        if text is None:
            return NO_PROMPT
        if (kept := self.prompts.get(text)) is None:
            if len(self.prompts) >= self.KEPT:
                self.prompts.clear()
            key = INNER_PROMPT.sub("X", DIGITS.sub("0", text))
            if (known := self.prompts.get(key)) is None:
                body = WRAPPER.sub(" ", text)
                told = self.languages.scores(body)
                best = told.index(top) if told and (top := max(told)) > 1.0 else -1
                asked = frozenset(i for i, c in enumerate(self.languages.codes) if c in ASKED and ASKED[c].search(body)) if ANY_ASKED.search(body) else frozenset()
                known = self.prompts[key] = (best, READ.search(body) is not None, asked)
            if known[0] < 0 and truncation.contentless(WRAPPER.sub(" ", text)):
                kept = self.prompts[text] = NO_PROMPT
                return kept
            words = frozenset(WORD.findall(text.replace("<image>", " ").casefold()))
            longest = sorted(words, key=lambda w: (len(w), w))[-4:]
            pieces = tuple(longest) if longest and len(longest[-1]) > 2 else tuple(words)
            kept = self.prompts[text] = (*known, pieces, words)
        return kept

    @staticmethod
    def overlap(prompt, response: str) -> tuple[int, int]:
        """How much of the response is the prompt's words, and how much of the prompt it gives back; in fifths and quarters."""
        pieces, asked = prompt[3], prompt[4]
        if not asked:
            return -1, -1
        lower = response.casefold()
        if sum(p in lower for p in pieces) * 2 < len(pieces):
            return 0, 0
        said = set(WORD.findall(lower))
        both = len(asked & said)
        return int(both / max(len(said), 1) * 5), int(both / max(len(asked), 1) * 4)

    @staticmethod
    def echo(prompt, clause: str, overlap: tuple[int, int]) -> int:
        """How much of a clause is the prompt's words, in fourths; only looked at where the response has some of them."""
        if overlap[0] <= 0:
            return overlap[0]
        said = WORD.findall(clause.casefold())
        return int(sum(w in prompt[4] for w in said) / max(len(said), 1) * 4)

    def context(self, prompt, overlap: tuple[int, int], echo: int, told: list[float], at: int, of: int, cut: bool) -> tuple:
        """What a clause is within its pair."""
        home, reads, asked = prompt[:3]
        far = None
        if home >= 0:
            top = max(told)
            gap = top - told[home]
            far = (min(int(gap / 1.5), 4) if gap > 0 else -1, reads, bool(asked) and told.index(top) in asked)
        return min(at, 2), at == of - 1, min(of, 4), overlap, echo, far, reads, cut and at == of - 1

    @staticmethod
    def spelled(context: tuple) -> list[str]:
        at, last, of, overlap, echo, far, reads, cut = context
        return [f"at{at}{last}", f"of{of}", f"echo{overlap}", f"own{echo}", f"own{echo}{overlap[1]}", f"reads{reads}", f"far{far}", f"far{far}{of == 1}", f"cut{cut}"] + ["unfinished"] * cut * 24  # one sign against all words of a long clause

    def read(self, prompt, response: str, cut: bool, overlap: tuple[int, int]) -> tuple[list[str], list[tuple], list[list[float]]]:
        """Clauses with numbers and names left open, what they are within the pair, and their language scores."""
        plainly = clauses(opened := plain(response)) or [opened]
        told = [self.clause(c)[1] for c in plainly]
        spoken = plainly if overlap[0] <= 0 else clauses(response) or [response]
        if len(spoken) != len(plainly):
            spoken = plainly
        about = [self.context(prompt, overlap, self.echo(prompt, c, overlap), t, i, len(plainly), cut) for i, (c, t) in enumerate(zip(spoken, told, strict=True))]
        return plainly, about, told

    def tag(self, prompt, response: str, cut: bool, overlap: tuple[int, int]) -> tuple[list[int], list[str], list[float]]:
        """Labels of the clauses, the clauses with numbers and names left open, language scores of the whole."""
        parts, abouts, languages = self.read(prompt, response, cut, overlap)
        rows: list[list[float]] = []
        sure = True
        for part, about in zip(parts, abouts, strict=True):
            if (extra := self.contexts.get(about)) is None:
                extra = self.contexts[about] = self.field.emit[_hash(self.spelled(about))].sum(axis=0).tolist()
            row = [a + b for a, b in zip(self.clause(part)[0], extra, strict=True)]
            sure = sure and row[0] - max(row[1:]) > self.bound
            rows.append(row)
        if cut:
            rows[-1][UNFINISHED] += CUT_ODDS
            sure = False
        whole = languages[0] if len(parts) == 1 else [sum(x) for x in zip(*languages, strict=True)]
        return [ANSWER] * len(parts) if sure else self.best(rows), parts, whole

    def best(self, rows: list[list[float]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        state = [a + b for a, b in zip(self.begin, rows[0], strict=True)]
        trail: list[list[int]] = []
        for row in rows[1:]:
            arrows, ahead = [], []
            for k, u in enumerate(row):
                moves = [s + self.step[j][k] for j, s in enumerate(state)]
                top = max(moves)
                arrows.append(moves.index(top))
                ahead.append(top + u)
            trail.append(arrows)
            state = ahead
        labels = [state.index(max(state))]
        for arrows in reversed(trail):
            labels.append(arrows[labels[-1]])
        return labels[::-1]

    def defect(self, prompt: str | None, response: str | None, cut: bool) -> str | None:
        """By the coverage of the labels; exact checks may only take a label back."""
        if truncation.contentless(response):
            return "empty_answer"
        about = self.prompt(prompt)
        prompted = about is not NO_PROMPT
        labels, parts, told = self.tag(about, response, cut, self.overlap(about, response))
        if not any(labels):
            return None
        cover = [0.0] * len(LABELS)
        whole = max(sum(map(len, parts)), 1)
        for label, part in zip(labels, parts, strict=True):
            cover[label] += len(part) / whole
        if prompted and cover[ECHO] > 0.5 and copied(prompt, response):
            return "copied_question"
        if cut and cover[UNFINISHED] > 0:
            return "truncated_answer"
        if cover[REFUSAL] > 0.4 and cover[REFUSAL] >= cover[ANSWER]:
            return "refusal"
        home, reads, asked = about[:3]
        if prompted and home >= 0 and not reads and cover[FOREIGN] >= 0.5:
            best = told.index(max(told))
            if best != home and best not in asked and told[best] - told[home] > MARGIN:
                return "wrong_language"
        return None


# --- learning -----------------------------------------------------------------------------------------------

Sequences = list[tuple[list[list[int]], list[int]]]


class Lessons:
    """Clause features and labels for the field, from pairs without labels."""

    def __init__(self, pairs: list[tuple[str | None, str]], tagger: Tagger, seed: int = 3) -> None:
        self.tagger, self.rng = tagger, random.Random(seed)
        self.whole = [(q, a) for q, a in pairs if a and not truncation.contentless(a)]
        cut = truncation.score_texts([a for _, a in self.whole], ["gpt"] * len(self.whole), [None] * len(self.whole), tagger.cut)
        self.cut = [bool(c) for c in cut]
        self.told = [s.index(max(s)) if (s := tagger.languages.scores(a)) and max(s) > 3 else -1 for _, a in self.whole]
        self.home = [tagger.prompt(q)[0] if q else -1 for q, _ in self.whole]
        about = [self.tagger.prompt(q) for q, _ in self.whole]
        seen = [self.tagger.overlap(p, a) for p, (_, a) in zip(about, self.whole, strict=True)]
        self.copy = [bool(q) and o[0] >= 2 and o[1] >= 1 and copied(q, a) for o, (q, a) in zip(seen, self.whole, strict=True)]
        self.rows = [self.row(q, a, c) for (q, a), c in zip(self.whole, self.cut, strict=True)]
        self.quoted = {normal(m.strip("\"“”„«»「」『』")) for _, a in self.whole for m in QUOTED.findall(a)}

    def row(self, prompt: str | None, response: str, cut: bool = False) -> tuple[list[list[int]], list[str]]:
        about = self.tagger.prompt(prompt)
        parts, abouts, _ = self.tagger.read(about, response, cut, self.tagger.overlap(about, response))
        return [_hash(wording(c) + self.tagger.spelled(x)) for c, x in zip(parts, abouts, strict=True)], parts

    def wordless(self, prompt: str | None, response: str) -> list[list[int]]:
        """What is known of a response whose words say nothing."""
        about = self.tagger.prompt(prompt)
        parts, abouts, _ = self.tagger.read(about, response, False, self.tagger.overlap(about, response))
        return [_hash([f"size{min(len(WORD.findall(c)), 8)}", *self.tagger.spelled(x)]) for c, x in zip(parts, abouts, strict=True)]

    def made(self) -> Sequences:
        """Refusals composed, prompts given back, responses in another language, responses cut short."""
        out: Sequences = []
        rng, whole = self.rng, self.whole

        def add(prompt: str | None, response: str, label: int, cut: bool = False) -> None:
            rows, parts = self.row(prompt, response, cut)
            out.append((rows, [ANSWER] * (len(parts) - 1) + [label] if cut else [label] * len(parts)))

        by: dict[int, list[int]] = {}
        for i, t in enumerate(self.told):
            if t >= 0 and self.home[i] == t and grounded(whole[i][1]):
                by.setdefault(t, []).append(i)
        prompts: dict[str, list[str]] = {}
        for i, (q, _) in enumerate(whole):
            if q and self.home[i] >= 0:
                prompts.setdefault(self.tagger.languages.codes[self.home[i]], []).append(q)
        every = [q for q, _ in whole if q]
        for code in PARTS:
            for _ in range(COMPOSED * (3 if code == "en" else 1)):
                q = rng.choice(prompts[code]) if code in prompts and rng.random() < 0.8 else rng.choice(every) if every and rng.random() < 0.8 else None
                add(q, composed(code, rng, _thing(q, code, rng)), REFUSAL)
        codes = sorted(by)
        for i, (q, a) in enumerate(whole):
            pick = rng.random()
            if q and pick < 0.12:
                add(q, rng.choice((q, f"Q: {q}", q.upper(), f"{q} {q}", q.rstrip("?？. ") + "\n=>", q.casefold(), f"\"{q}\"", q.replace(" ", "  "), f"You asked: {q}", _slipped(q, rng), f"{q}\nAnswer:")), ECHO)
            elif q and pick < 0.3 and self.home[i] >= 0 and len(codes) > 1 and not self.tagger.prompt(q)[1]:
                if other := [c for c in codes if c != self.home[i] and c not in self.tagger.prompt(q)[2]]:
                    add(q, whole[rng.choice(by[rng.choice(other)])][1], FOREIGN)
            elif pick < 0.42 and len(a) > 30 and not self.cut[i]:
                add(q, a[: int(len(a) * rng.uniform(0.3, 0.9))], UNFINISHED, True)
        return out

    def read(self, learned: bool) -> Sequences:
        """The responses of the sample: what is sure of them at first, then tagged by the field learned so far."""
        out: Sequences = []
        for i, (q, a) in enumerate(self.whole):
            rows, parts = self.rows[i]
            if self.copy[i]:
                out.append((rows, [ECHO] * len(parts)))
                continue
            about = self.tagger.prompt(q)
            if self.home[i] >= 0 and self.told[i] >= 0 and self.home[i] != self.told[i] and not about[1] and self.told[i] not in about[2] and not (learned and self.tagger.defect(q, a, self.cut[i]) == "refusal"):
                continue  # left open: it may be the very defect
            tags = [ANSWER] * len(parts)
            safe = grounded(a) or normal(a) in self.quoted
            if learned and not safe:
                gap = sum(e[REFUSAL] - e[ANSWER] for e in (self.tagger.field.emit[r].sum(axis=0) for r in rows))
                if gap > 0:
                    tags = [REFUSAL] * len(parts)
                elif gap > -UNSURE and not truncation.is_short(a.strip()):
                    continue
            elif not (grounded(a) or truncation.is_short(a.strip()) or normal(a) in self.quoted):
                continue
            if self.cut[i]:
                tags[-1] = UNFINISHED
            out.append((rows, tags))
            if not any(tags) and self.rng.random() < 0.03:  # without any sign of another label it is an answer
                out.append((self.wordless(q, a), tags))
        return out


def _thing(prompt: str | None, code: str, rng: random.Random) -> str | None:
    """Something that the prompt names: its last words."""
    if not prompt or rng.random() < 0.5:
        return None
    words = WORD.findall(WRAPPER.sub(" ", prompt))
    n = rng.randint(1, 4)
    return ("" if code in ("zh", "ja") else " ").join(words[-n:]) or None


def _slipped(text: str, rng: random.Random) -> str:
    """A text with a letter lost."""
    at = rng.randrange(len(text))
    return text[:at] + text[at + 1 :]


def learn_field(pairs: list[tuple[str | None, str]], tagger: Tagger) -> Tagger:
    lessons = Lessons(pairs, tagger)
    made = lessons.made()
    tagger.field.fit([*made, *lessons.read(False)])
    for _ in range(2):
        tagger.forget()
        again = [*made, *lessons.read(True)]
        tagger.field = ChainCRF(LABELS).fit(again)
    tagger.forget()
    return tagger


def language_texts(spoken: list, asked: list) -> list[tuple[str, str]]:
    """Texts with their language as labelled; prompts for a language or for words seen are left out with what follows."""
    texts = []
    for r in spoken:
        turns = [t for t in r["conversations"] if t["value"] and t["from_role"] in ("human", "gpt")]
        if r["code"] and not any(p.search(t["value"]) for t in turns for p in ASKED.values()):
            texts += [(WRAPPER.sub(" ", t["value"]), r["code"]) for t in turns if not READ.search(t["value"])]
    for r in asked:
        if r["code"] and r["question"]:
            texts.append((WRAPPER.sub(" ", r["question"]), r["code"]))
            if r["answer"] and not READ.search(r["question"]):
                texts += [(x, r["code"]) for x in r["answer"][:1] if x]
    return texts


def learn(conversation: DataFrame, prediction: DataFrame, question: DataFrame, sizes: DataFrame) -> Tagger:
    """The tagger, from one sample of each table, drawn in one pass; rows of rare languages are drawn by language."""
    turns = truncation.SAMPLE * 2 // 3
    count = sizes.groupBy("tbl", "lang").agg(F.sum("n").alias("n"), F.sum("first").alias("first")).collect()  # a row a language
    texts = {t: sum(r["n"] for r in count if r["tbl"] == t) for t in ("conversation", "prediction")}
    code = language(F.col("lang")).alias("code")

    base = truncation.share(turns, texts["conversation"])
    spoken = {r["lang"]: max(base, truncation.share(PER_LANGUAGE // 2, r["first"])) for r in count if r["tbl"] == "conversation" and r["lang"]}
    drawn = conversation.select("row_id", "source", "conversations", code, truncation.chosen("row_id", {"": base}).alias("base")).where(truncation.chosen("row_id", spoken | {"": base}, language(F.col("lang"))) & (F.size("conversations") > 0))
    records = sorted(drawn.drop("source").collect(), key=lambda r: (crc32(str(r["row_id"]).encode()), r["row_id"]))

    given = truncation.chosen("pred_id", {"": truncation.share(truncation.SAMPLE - turns, texts["prediction"])})
    answers = prediction.where(given & F.col("answer").isNotNull()).select("pred_id", "source", "split", "question_id", "answer").collect()
    answers = sorted(answers, key=lambda r: (crc32(str(r["pred_id"]).encode()), r["pred_id"]))
    named = answers[: SAMPLE // 2]
    keys = sorted({(r["source"], r["split"], r["question_id"]) for r in named if None not in (r["source"], r["split"], r["question_id"])})

    many = {r["code"]: r["n"] for r in question.groupBy(code).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    shares = {c: truncation.share(PER_LANGUAGE // 2, n) for c, n in many.items() if c}
    wanted = prediction.sparkSession.createDataFrame(keys, "source string, split string, question_id string").withColumn("named", F.lit(True))  # SAMPLE / 2 rows at most
    met = question.select("record_id", "source", "split", "question_id", "question", "answer", code).join(F.broadcast(wanted), ["source", "split", "question_id"], "left")
    met = met.withColumn("told", truncation.chosen("record_id", shares, F.col("code"))).where("named or told").collect()
    asked: dict[tuple, tuple[int, str]] = {}
    for r in met:
        key = (r["source"], r["split"], r["question_id"])
        if r["named"] and (key not in asked or r["record_id"] < asked[key][0]):
            asked[key] = (r["record_id"], r["question"])

    cut: list[dict] = []
    for r in records:
        if r["base"]:
            cut += [{"rec_key": r["row_id"], "turn_no": i, "text": t["value"], "kind": t["from_role"]} for i, t in enumerate(r["conversations"]) if t["value"] is not None and t["from_role"] in ("human", "gpt")]
    weights = truncation.fit(truncation.drawn(cut, turns) + truncation.drawn([{"rec_key": r["pred_id"], "turn_no": -1, "text": r["answer"], "kind": "answer"} for r in answers], truncation.SAMPLE - turns))
    languages = Languages.fit(language_texts(records, [r for r in met if r["told"]]))
    pairs = [(p["value"], t["value"]) for r in records for p, t in zip(r["conversations"], r["conversations"][1:], strict=False) if p["from_role"] == "human" and t["from_role"] == "gpt" and t["value"]][: SAMPLE // 2]
    pairs += [(asked.get((r["source"], r["split"], r["question_id"]), (0, None))[1], r["answer"]) for r in named]
    return learn_field(pairs, Tagger(ChainCRF(LABELS), languages, weights))


# --- records ------------------------------------------------------------------------------------------------


def conversation_pairs(df: DataFrame) -> DataFrame:
    """Every human turn with the gpt turn directly after it."""
    turns = F.transform(
        F.sequence(F.lit(1), F.size("conversations") - 1),
        lambda i: F.struct(i.alias("turn_no"), F.element_at("conversations", i).alias("p"), F.element_at("conversations", i + 1).alias("r")),
    )
    return (
        df.where(F.size("conversations") > 1)
        .select(F.col("row_id").cast("long").alias("rec_key"), "source", F.explode(turns).alias("t"))
        .where((F.col("t.p.from_role") == "human") & (F.col("t.r.from_role") == "gpt"))
        .select(F.lit("conversation").alias("tbl"), "rec_key", F.col("t.turn_no").cast("long").alias("turn_no"), "source", F.lit("gpt").alias("kind"), F.col("t.p.value").alias("prompt"), F.col("t.r.value").alias("response"))
    )


def prediction_pairs(prediction: DataFrame, question: DataFrame) -> DataFrame:
    """Every model answer with its question, if there is one."""
    key = ["source", "split", "question_id"]
    asked = question.where(F.col("question_id").isNotNull() & F.col("split").isin("val", "test")).groupBy(*key).agg(F.min_by("question", "record_id").alias("prompt"))
    # answers without a question_id would meet in one task: each gets a key of its own that no question has
    own = F.coalesce("question_id", F.concat(F.lit("\0"), F.col("pred_id").cast("string"))).alias("question_id")
    answers = prediction.select(F.col("pred_id").cast("long").alias("rec_key"), "source", "split", own, F.col("answer").alias("response"))
    return answers.join(asked, key, "left").select(F.lit("prediction").alias("tbl"), "rec_key", F.lit(-1).cast("long").alias("turn_no"), "source", F.lit("answer").alias("kind"), "prompt", "response")


def defects(conversation: DataFrame, prediction: DataFrame, question: DataFrame) -> DataFrame:
    """tbl, rec_key, turn_no, source, defect of every defective pair."""
    sizes = truncation.lengths(conversation, prediction)
    tagger = learn(conversation, prediction, question, sizes)
    carried = conversation.sparkSession.sparkContext.broadcast(tagger)  # a few MB, and 1 MB a language
    pairs = conversation_pairs(spread(conversation.select("row_id", "source", "conversations"))).unionByName(prediction_pairs(prediction, question))
    rows = truncation.with_room(pairs, truncation.limits(sizes), "response").select("tbl", "rec_key", "turn_no", "source", "prompt", "response", "kind", "room")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = carried.value
        for batch in batches:
            if not batch.num_rows:
                continue
            prompts, responses, kinds, rooms = (batch.column(i).to_pylist() for i in range(4, 8))
            cut = truncation.score_texts([r or "" for r in responses], kinds, rooms, tagger.cut)
            found = pa.array([tagger.defect(p, r, bool(c)) for p, r, c in zip(prompts, responses, cut, strict=True)], pa.string())
            table = pa.table([*batch.columns[:4], found], ["tbl", "rec_key", "turn_no", "source", "defect"])
            yield from table.filter(found.is_valid()).to_batches()

    return rows.mapInArrow(run, "tbl string, rec_key long, turn_no long, source string, defect string")


def found(conversation: DataFrame, prediction: DataFrame, question: DataFrame) -> DataFrame:
    return defects(conversation, prediction, question).select("tbl", "rec_key", "turn_no", "defect")


def by_source(conversation: DataFrame, prediction: DataFrame, question: DataFrame) -> DataFrame:
    return defects(conversation, prediction, question).groupBy("tbl", F.coalesce("source", F.lit("unknown")).alias("source"), "defect").agg(F.count(F.lit(1)).alias("pairs"))
