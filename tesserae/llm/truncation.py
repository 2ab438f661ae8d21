"""Texts cut off by field limits or in transfer.

A hashed logistic regression reads the close of a text: its last characters and words, the marks after them, what
is still open, the beginning of its last sentence, and how far its length is below the limit of its source. Its
training rows are made from intact values of a bounded sample: the values as they are and without their closing
mark are negatives, the same values cut at a random place positives, some of them with a mark put in place of the
end. The model then scores every text of every record; no rule decides before it but that a text without content has
no end to lose. A limit of a source is a length that far more of its texts have than the lengths just below, and few
of them pass; it comes from an aggregate over all rows, which also gives the counts that the sample is drawn by.

Defined cases: null, blank and contentless texts (only marks or invisible characters) are whole; trailing image marks
are left out; repeated rows are scored each; an empty table gives no rows; with no intact text to learn from every
text counts as whole.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import cut as cut_lineage
from tesserae.llm.common import language, spread
from tesserae.llm.learn import fit_logistic, hashed, scores
from tesserae.llm.sentences import ABBREVIATIONS

#: Bound of the sample of texts that the classifier learns from.
SAMPLE = 21000
#: Log-odds from which a text counts as cut off.
THRESHOLD = 0.0
#: A source has a limit at a length whose count lies so many standard deviations above the mean of the counts of so
#: many lengths just below, and is at least this part of the source's texts.
STANDS_OUT, BELOW, PART = 3, 12, 0.001
#: Limits of so many sources are sent to every task; those of more are joined by a shuffle, in so many parts a source.
FEW, PARTS = 10_000, 64
#: Room to the limit that a text may have left for its length to say something.
ROOMS = ((0, "0"), (2, "1"), (8, "3"))

IMAGE = re.compile(r"\s*<(?:image|video|img)>(?:\s*</img>)?\s*$")
#: Marks put in place of a lost end: dots, replacement characters, a word or dots of that meaning in brackets.
BRACKETED = ("cut", "cut off", "truncated", "more", "continued", "snip", "eot", "...", "…")
MARKS = re.compile(r"\s*(?:\.{3,}|…+|�+|[<\[({](?:" + "|".join(map(re.escape, BRACKETED)) + r")[>\])}]|\s\"$)\s*$", re.I)
NEUTRAL = re.compile(r"\s*(?:=+>|->|→)\s*$|\n\s*(?:A|Answer|Antwort|Respuesta|Réponse|回答|答案|答)\s*[:：]\s*$")
CONTENT = re.compile(r"[^\W_]")
#: Stand-ins for a missing value and empty frames.
STAND_IN = re.compile(r"^[\W_]*(?:(?:no answer|no response|answer|response|blank|empty|none|null|nil|nan|n/?a|not available|missing|tbd|undefined|unknown|无|無|空|なし|keine angabe|sin respuesta|sans réponse)[\W_]*){0,2}$", re.I)
END = re.compile(r"[.!?。！？।؟｡…][\"'”’»«“』」)）\]】>*_`]*$|\.\s?[”»\"]$|[.!?。！？][\s  ]?»$")
CLOSING = re.compile(r"[\s  ]*[.!?。！？।؟｡]+[\s  ]*[\"'”’»“』」)）\]】]*$|[\"'”’»“』」)）\]】]+[.。]*$")
#: Short phrases: one or two words, a number with its unit, a few characters of a script without blanks.
SHORT = re.compile(r"[^\s<>()\"„“«「（]+(?:\s[^\s<>()\"„“«「（]+)?|[\d.,]+\s?[^\s<>()\"„“«「（]+(?:\s[^\s<>()\"„“«「（]+)?")
CJK_LONG = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]{7}|[\u3040-\u30ff\u3400-\u9fff].*[，、。]")
SENTENCE = re.compile(r"[.!?][\"”»)]*[\s  ]+(?=[\"“„«(¿¡—\d]*[^\W\da-zß-ÿа-я])|[。！？][”」）]?|\n+")
STOP = re.compile(r"\s*[.!?。！？।؟｡…\n]")
OPEN_TAG = re.compile(r"<(?:ref|quad|box)>(?![^<]*</)|&[a-z]{1,6}$|\\u[0-9a-f]{0,3}$|<[a-z]{0,6}$")
WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+|[^\w\s]")
DIGITS = re.compile(r"\d+")
NAME = re.compile(r"[A-ZÀ-ÝА-Я][a-zß-ÿа-я]+$")


def contentless(text: str | None) -> bool:
    """Nothing but blanks, invisible characters, punctuation, an empty frame or a stand-in for a missing value."""
    return not text or STAND_IN.match(text) is not None or CONTENT.search(text) is None


def is_short(body: str) -> bool:
    """One or two words, a number with its unit, or a few characters of a script without blanks."""
    return SHORT.fullmatch(body) is not None and not CJK_LONG.search(body)


def room_kind(room: int | None) -> str:
    """How near the text's length is to the next limit of its field; empty where there is none near."""
    return next((name for most, name in ROOMS if room <= most), "") if room is not None and room >= 0 else ""


def strip_marks(text: str) -> tuple[str, str]:
    """A text without trailing image marks, blanks and marks put in place of a lost end; and the last such mark."""
    body = text.rstrip("\ufeff\u200b \t\r\n\xa0\u3000")
    while body.endswith(">") and (m := IMAGE.search(body)):
        body = body[: m.start()]
    if body[-1:] in ">→:：" and (m := NEUTRAL.search(body)):
        return body[: m.start()].rstrip(), ""
    mark = ""
    while body[-1:] in ".…�>])\"" and (m := MARKS.search(body)) and m.end() > m.start():
        mark = m.group().strip() or mark
        body = body[: m.start()]
    return body.rstrip(), mark


def _last_sentence(body: str) -> tuple[str, bool]:
    """The last sentence of a text, however long, and whether another one stands before it."""
    window = 160
    while True:
        tail = body[-window:]
        cuts = list(SENTENCE.finditer(tail))
        begin = cuts[-1].end() if cuts and cuts[-1].end() < len(tail) else cuts[-2].end() if len(cuts) > 1 else 0
        if begin or len(tail) == len(body):
            return tail[begin:], begin > 0
        window *= 4


def close_of(text: str, kind: str, room: int | None) -> list[str] | None:
    """Features of the close of a text, or None where there is no content."""
    body, mark = strip_marks(text)
    if contentless(body):
        return None
    broken = text.rstrip().endswith("�")
    tail = body[-160:]
    last = tail[-1]
    ended = bool(END.search(tail[-8:]))
    near = room_kind(room)
    short = is_short(body)
    abbreviated = last == "." and ABBREVIATIONS.look(tail, len(tail) - 1) != ""
    group = "e" if ended else "c" if last in "\"'”’»“』」)）]】>" else "d" if last.isdigit() else "p" if last in "%°€$" else "w" if last.isalnum() else "x"
    size = "1" if len(body) < 24 else "2" if len(body) < 60 else "3"
    state = f"{group}{'m' if mark else ''}{'b' if broken else ''}"
    found = [f"g{state}{near}", f"l{near}{ended}", f"e{ended}{bool(mark)}{abbreviated}", f"k{kind}{group}{size}"]
    if mark:
        found.append(f"m{ended}")
    if ended and not abbreviated and not mark:
        return found
    opens = "".join(
        name
        for name, a, b in (("(", "(", ")"), ("（", "（", "）"), ("[", "[", "]"), ("“", "“", "”"), ("«", "«", "»"), ("<", "<", ">"), ("「", "「", "」"))
        if text.count(a) > text.count(b) and (a != "“" or "„" not in text)
    )
    if text.count("„") > text.count("“") - text.count("”"):
        opens += "„"
    if text.count('"') % 2:
        opens += '"'
    if OPEN_TAG.search(tail):
        opens += "t"
    found.append(f"o{opens}{group}")
    if short and not opens and not mark:  # its words say nothing of an end
        return [*found, f"p{kind}{group}{min(len(body), 16)}", f"P{kind == 'human'}{broken}{near == '0'}", f"z{DIGITS.sub('0', tail.casefold())}"]
    if ended:
        return found
    sentence, after = _last_sentence(body)
    if after:
        found.append(f"after{group}")
    raw = WORD.findall(sentence)
    shaped = ["Xx" if i and NAME.match(w) and not w.isupper() else DIGITS.sub("0", w.casefold()) for i, w in enumerate(raw)]
    words = [w for w in shaped if w[0].isalnum()] or shaped
    w1, w2, w3 = ([*[""] * 3, *words])[-1], ([*[""] * 3, *words])[-2], ([*[""] * 3, *words])[-3]
    lower = DIGITS.sub("0", tail.casefold())
    head = " ".join(words[:2])
    n = min(len(words), 24)
    word = raw[-1] if raw else ""
    found += [f"1{w1}", f"2{w2} {w1}", f"3{w3} {w2} {w1}", f"h{head}|{w1}", f"i{head}|{w2} {w1}", f"n{head}|{n}", f"r{word[-1:]}{last}", f"y{w1}|{last}", f"q{w2} {w1}|{group}"]
    found += [f"s{k}{lower[-k:]}" for k in range(1, 7)]
    found.append(f"v{'Xx' if NAME.match(word) else word.casefold()[-3:]}|{min(len(word), 9)}")
    if NAME.match(word):
        found += [f"N{k}{word[-k:]}" for k in (2, 3, 4)]
    if size == "1":
        found += [f"z{lower[:24]}", f"u{len(words)}{group}"]
    return found


# --- training -----------------------------------------------------------------------------------------------


def _shape(text: str) -> str:
    """A value with its numbers and names left open."""
    return re.sub(r"[A-ZÀ-ÝА-Я][a-zß-ÿа-я]+(?![^\s.,])", "X", DIGITS.sub("0", text.strip()))


def _mark(rng: random.Random) -> str:
    """What may stand in place of a lost end; mostly nothing."""
    kind = rng.random()
    if kind < 0.4:
        return ""
    blank = rng.choice(("", " "))
    if kind < 0.65:
        return blank + rng.choice(("...", "...", "…", "....", "……"))
    if kind < 0.92:
        opened, closed = rng.choice(("<>", "[]", "()"))
        return blank + opened + rng.choice(BRACKETED) + closed
    return "�"


def _markup(rng: random.Random) -> str:
    """A tag, entity or escape cut within."""
    n = [rng.randrange(1000) for _ in range(4)]
    whole = rng.choice((" &quot;", " &amp;", " &lt;", " \\u4e2d", f" <box>({n[0]},{n[1]}),({n[2]},{n[3]})</box>", f" <quad>({n[0]},{n[1]}),({n[2]},{n[3]})</quad>", " <ref>the thing</ref>", "</answer>"))
    return whole[: rng.randrange(2, len(whole) - 1)]


def training_rows(values: list[tuple[str, str]], seed: int = 11) -> tuple[list[list[int]], list[int]]:
    """Hashed rows and labels from (text, kind) values: intact ones, ones without closing mark, and cut ones."""
    rng = random.Random(seed)
    rows: list[list[int]] = []
    labels: list[int] = []
    often = Counter(_shape(t) for t, _ in values)

    def add(text: str, kind: str, label: int, full: float) -> None:
        room = 0 if (chance := rng.random()) < full else rng.randrange(1, 9) if chance < full + 0.02 else rng.choice((None, 50))
        if (found := close_of(text, kind, room)) is not None:
            rows.append(hashed(found))
            labels.append(label)

    for text, kind in values:
        body = text.rstrip()
        while m := IMAGE.search(body):
            body = body[: m.start()].rstrip()
        _, mark = strip_marks(body)
        if mark or not CONTENT.search(body):
            continue
        if not END.search(body):
            if often[_shape(text)] >= 3 or is_short(body):
                add(body, kind, 0, 0.01)
            continue
        add(body, kind, 0, 0.02)
        if rng.random() < 0.05:  # a mark behind a whole sentence
            add(body + "\n" * (rng.random() < 0.5) + _mark(rng), kind, 0, 0.0)
        bare = CLOSING.sub("", body)
        if bare and bare != body:
            add(bare, kind, 0, 0.0)
            if rng.random() < 0.3:
                add(bare.casefold(), kind, 0, 0.0)
        # intact shorter forms: the same value up to each earlier sentence end
        ends = [m.start() + 1 + (m.group()[1:2] in '"”»)」）') for m in SENTENCE.finditer(body)]
        if ends:
            part = body[: rng.choice(ends)]
            add(part, kind, 0, 0.0)
            if len(bare := CLOSING.sub("", part)) < len(part):
                add(bare, kind, 0, 0.0)
        if rng.random() < 0.3:  # a short phrase, which is no case
            said = body.split()
            at = rng.randrange(len(said))
            phrase = str(rng.randrange(1000)) if rng.random() < 0.2 else " ".join(said[at : at + rng.choice((1, 2))]).strip(".,;:!?()[]\"")
            if is_short(phrase) and not END.search(phrase):
                add(phrase, kind, 0, 0.0)
        inner = [i for i in range(max(6, min(len(body) // 6, 40)), len(body) - 1) if body[i - 1 : i] not in ".!?。！？\n"]
        if len(WORD.findall(body)) < 5 or not inner:
            continue
        for _ in range(2):
            cut = body[: rng.choice(inner)]
            rest = body[len(cut) :]
            if not CONTENT.search(rest) or END.search(cut.rstrip()) or STOP.match(rest):
                continue  # whole, or whole but for a closing mark
            mark = _mark(rng)
            if mark or not is_short(cut.strip()):  # a bare short phrase is no case
                add(cut + mark, kind, 1, 0.3)
            if rng.random() < 0.08:  # within markup
                add(cut.rstrip() + _markup(rng), kind, 1, 0.1)
    return rows, labels


def fit(values: list[tuple[str, str]]) -> np.ndarray:
    rows, labels = training_rows(values)
    return fit_logistic(rows, labels)


# --- records ------------------------------------------------------------------------------------------------


def conversation_texts(df: DataFrame, *more: str) -> DataFrame:
    """tbl, rec_key, turn_no, source, kind, text of every human and gpt turn."""
    turn = F.posexplode("conversations").alias("turn_no", "turn")
    return (
        df.select(F.col("row_id").cast("long").alias("rec_key"), "source", *more, turn)
        .select(F.lit("conversation").alias("tbl"), "rec_key", F.col("turn_no").cast("long").alias("turn_no"), "source", F.col("turn.from_role").alias("kind"), F.col("turn.value").alias("text"), *more)
        .where(F.col("kind").isin("human", "gpt") & F.col("text").isNotNull())
    )


def prediction_texts(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        F.lit("prediction").alias("tbl"), F.col("pred_id").cast("long").alias("rec_key"), F.lit(-1).cast("long").alias("turn_no"), "source", F.lit("answer").alias("kind"), F.col("answer").alias("text"), *(F.lit(None).cast("string").alias(m) for m in more)
    ).where(F.col("text").isNotNull())


def lengths(conversation: DataFrame, prediction: DataFrame) -> DataFrame:
    """tbl, source, kind, lang, size, n, first, marks: how many texts there are of each length; small, and written once.

    `first` counts the records that begin there, `marks` has a bit a text, for how many of them differ.
    """
    mark = F.expr("shiftleft(1L, cast(pmod(xxhash64(text), 64) as int))")
    texts = conversation_texts(conversation.select("row_id", "source", language(F.col("lang")).alias("lang") if "lang" in conversation.columns else F.lit(None).cast("string").alias("lang"), "conversations"), "lang")
    every = texts.unionByName(prediction_texts(prediction, "lang"))
    begun = F.count_if(F.col("turn_no") <= F.when(F.col("kind") == "human", 1).otherwise(-1))
    return cut_lineage(every.groupBy("tbl", "source", "kind", "lang", F.length("text").alias("size")).agg(F.count(F.lit(1)).alias("n"), begun.alias("first"), F.bit_or(mark).alias("marks")))


def chosen(key: str, shares: dict[str, float], by: Column | None = None, salt: int = 1) -> Column:
    """Rows whose key's hash is below the share of their group ('' is any other)."""
    below = F.lit(shares.get("", 0.0))
    if by is not None:
        for code, share in shares.items():
            below = F.when(by == code, F.lit(share)).otherwise(below)
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) < below * float(1 << 30)


def share(wanted: int, of: int) -> float:
    """The part of `of` rows that holds about `wanted` of them, and a quarter more."""
    return min(1.0, 1.25 * wanted / max(of, 1))


def sample(conversation: DataFrame, prediction: DataFrame, sizes: DataFrame, bound: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `bound` texts in a fixed order by the hash of their record, two thirds from conversations; one pass over either table."""
    count = {r["tbl"]: r for r in sizes.groupBy("tbl").agg(F.sum("n").alias("n")).collect()}
    turns = bound * 2 // 3
    texts = {t: count[t]["n"] if t in count else 0 for t in ("conversation", "prediction")}
    a = conversation_texts(conversation.where(chosen("row_id", {"": share(turns, texts["conversation"])})).select("row_id", "source", "conversations")).select("rec_key", "turn_no", "text", "kind").collect()
    b = prediction_texts(prediction.where(chosen("pred_id", {"": share(bound - turns, texts["prediction"])}))).select("rec_key", "turn_no", "text", "kind").collect()
    return drawn(a, turns) + drawn(b, bound - turns)


def drawn(rows: list, most: int) -> list[tuple[str, str]]:
    """At most `most` texts with their kind, in the order of a hash of their record."""
    return [(r["text"], r["kind"]) for r in sorted(rows, key=lambda r: (crc32(str(r["rec_key"]).encode()), r["rec_key"], r["turn_no"]))[:most]]


def limits(sizes: DataFrame) -> DataFrame:
    """tbl, source, kind, caps: the field limits of the sources, from the lengths of all their texts; a source may have several.

    Of the texts that reach a limit most stop there. Texts that are alike, and forms of one length (more than half of a
    source's texts, none just below), show no limit. As a limit holds a part of its source's texts, there are at most
    1 / PART of a source.
    """
    by = ["tbl", "source", "kind"]
    sizes = sizes.groupBy(*by, "size").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("marks")).alias("unlike"))
    each = W.partitionBy(*by)
    below = F.coalesce(F.sum("n").over(each.orderBy("size").rangeBetween(-BELOW, -1)), F.lit(0))
    past = F.coalesce(F.sum("n").over(each.orderBy("size").rangeBetween(1, W.unboundedFollowing)), F.lit(0))
    near = sizes.where("size > 0").select(*by, "size", "n", "unlike", F.sum("n").over(each).alias("all"), below.alias("below"), past.alias("past"))
    mean = F.col("below") / BELOW
    limit = (F.col("n") > mean + STANDS_OUT * F.sqrt(mean + 1)) & (F.col("n") >= F.col("all") * PART) & (F.col("past") <= F.col("n"))
    limit &= (F.col("unlike") >= 32 * (1 - F.exp(-F.col("n") / 64))) & ((F.col("below") > 0) | (F.col("n") * 2 <= F.col("all")))
    return near.where(limit).groupBy(*by).agg(F.array_sort(F.collect_list("size")).alias("caps"))


def with_room(rows: DataFrame, caps: DataFrame, text: str, few: int = FEW) -> DataFrame:
    """The rows with room: by how many characters the text is below the next limit of its source's field; null without one.

    The limits are broadcast only when they are of few sources; else every source's limits are copied to the parts that
    its texts are dealt among, so that no source is one task's work.
    """
    caps = cut_lineage(caps)
    by = ["tbl", "source", "kind"]
    if caps.limit(few + 1).count() <= few:
        met = rows.join(F.broadcast(caps), by, "left")
    else:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("rec_key", "turn_no"), F.lit(PARTS)))
        met = dealt.join(caps.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), [*by, "part"], "left").drop("part")
    ahead = F.array_min(F.filter("caps", lambda c: c >= F.length(text)))
    return met.withColumn("room", (ahead - F.length(text)).cast("int")).drop("caps")


def score_texts(texts: list[str], kinds: list[str], rooms: list[int | None], weights: np.ndarray) -> np.ndarray:
    """Whether each text is cut off."""
    cut = np.zeros(len(texts), bool)
    if not weights.any():
        return cut
    rows: list[list[int]] = []
    seen: dict[tuple[str, str, str], int] = {}
    alike: dict[tuple[str, ...], int] = {}
    of = np.full(len(texts), -1, np.int64)
    for i, (t, k, a) in enumerate(zip(texts, kinds, rooms, strict=True)):
        key = (t, k, room_kind(a))
        if (at := seen.get(key)) is None:
            found = close_of(t, k, a)
            if found is None:
                at = -1
            elif len(found) > 6:
                at = len(rows)
                rows.append(hashed(found))
            elif (at := alike.get(same := tuple(found))) is None:
                at = alike[same] = len(rows)
                rows.append(hashed(found))
            seen[key] = at
        of[i] = at
    if rows:
        hit = scores(weights, rows) > THRESHOLD
        known = of >= 0
        cut[known] = hit[of[known]]
    return cut


def scored(conversation: DataFrame, prediction: DataFrame, weights: np.ndarray, sizes: DataFrame, keep_whole: bool = False) -> DataFrame:
    """The texts with whether they are cut off; only the cut ones unless keep_whole."""
    carried = conversation.sparkSession.sparkContext.broadcast(weights)  # 1 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = score_texts(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist(), carried.value)
            table = pa.table([*batch.columns[:4], pa.array(cut)], ["tbl", "rec_key", "turn_no", "source", "cut"])
            yield from (table if keep_whole else table.filter(pa.array(cut))).to_batches()

    texts = conversation_texts(spread(conversation.select("row_id", "source", "conversations"))).unionByName(prediction_texts(prediction.select("pred_id", "source", "answer")))
    rows = with_room(texts, limits(sizes), "text").select("tbl", "rec_key", "turn_no", "source", "text", "kind", "room")
    return rows.mapInArrow(run, "tbl string, rec_key long, turn_no long, source string, cut boolean")


def truncated(conversation: DataFrame, prediction: DataFrame, keep_whole: bool = False) -> DataFrame:
    sizes = lengths(conversation, prediction)
    return scored(conversation, prediction, fit(sample(conversation, prediction, sizes)), sizes, keep_whole)


def found(conversation: DataFrame, prediction: DataFrame) -> DataFrame:
    return truncated(conversation, prediction).select("tbl", "rec_key", "turn_no")


def by_source(conversation: DataFrame, prediction: DataFrame) -> DataFrame:
    """How often each source truncates."""
    return (
        truncated(conversation, prediction, keep_whole=True)
        .groupBy("tbl", F.coalesce("source", F.lit("unknown")).alias("source"))
        .agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("truncated"))
        .withColumn("share", F.round(F.col("truncated") / F.col("texts"), 6))
    )
