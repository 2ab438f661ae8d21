"""Same or near-same benchmark records across splits.

Every record gets a picture key and a canonical question; evaluation records are joined with training records on the hash
of both, and counted by split and source. The canonical question has its words after normalising case, width, accents,
punctuation and blanks, taking the prompt wrapper off, and mending slips of the pen against the vocabulary of the whole
corpus; words of closed classes (articles, adpositions, forms of be, have and do, question words) are left out, all
others stay: numbers, codes, names, sides, days, single letters. What is hashed is the bag of these words, so that
clauses may stand in another order; the pairs that meet are then held against each other word by word: one is the other,
or has one phrase in another place, or a phrase and a phrase with a number have changed places. Two things that have
changed places (a cup left of a plate) are two questions.

A word that is one slip away from another and too seldom to be mended from the vocabulary stands in a second key with
both forms as one. All texts are canonicalised once per distinct question, and there is one join for all kinds of keys.
No step emits the pairs of a group but the last, whose pairs are the result; AQE splits its hot keys.

Defined cases: a null or blank question asks nothing and is in no pair; a null picture leaves the question alone
to decide (against a record with a picture only if the question carries a code, as it then names its document);
repeated rows count each; ties do not exist; an empty table or split gives no pairs; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import cut, map_arrow, source_key

#: Closed classes that may differ while the same is asked: articles, adpositions, forms of be, have and do, question words
#: and pronouns, and what a question about a picture says of the picture (it can be seen, is shown or given).
FUNCTION = frozenset(
    "what which who whom is are was were be been being the a an of in on at to for by with as does do did has have had having that this these there its their it can could you we please i "
    "seen see visible shown given image picture photo figure "
    "le la les de du des en et un une est sont a ete par au aux ce cette il elle dans sur quel quelle quels quelles qui combien "
    "der die das dem den des ein eine einer eines ist sind wird wurde wurden werden hat haben von vom am im zu zum zur auf fur wer wem wen welche welcher welches welchen welchem was wie gilt es "
    "el los las del al una uno es son fue sido por que quien cual cuales cuantos cuantas cuanto cuanta tiene tienen hay "
    "的 是 为 為 在 中 图 圖 请 請 问 問 这 這 张 張 了 由 等 于 於 上 什 么 麼 里 裡 其 谁 誰 多 少 几 幾 哪 "
    "図 値 誰".split()
)
#: Asking for how much of it there is, which says no more than what it is.
MEASURE = re.compile(r"\bhow (?:big|large|high|long|much) (?=is\b|are\b|was\b|were\b)|\bwie (?:hoch|gross|groß|lang|viel) (?=ist\b|sind\b|war\b)")
#: Clitics, elided words and the letter between an inverted verb and its pronoun.
CLITIC = re.compile(r"(?<=\w)['’](?:s|re|ve|ll|d|m)\b|\b(?:l|d|qu|j|n|m|t|s|c)['’](?=\w)|\by a-t-il\b|(?<=\w)-t-(?=\w)")
#: Words that are spelled in two ways or say the same of a picture.
SAME = {"color": "colour", "anybody": "person", "anyone": "person", "someone": "person", "somebody": "person", "picked": "chose", "chosen": "chose", "choose": "chose", "over": "above", "said": "say", "percent": "percentage"}
#: Endings of inflected forms, taken off words of five letters and more.
ENDING = re.compile(r"(?<=[a-z]{3})(?:ing|ed|es|s|ido|io)$")
#: A word this many times as frequent may be what another one was meant to be.
RATIO = 10
#: Hiragana that are grammar, and words among them that ask.
KANA_ASKED = re.compile(r"いつ|どこ|なぜ|どの|どれ|だれ|なに")
KANA = re.compile(r"(?:ありますか|ました|ません|でした|ですか|ますか|ください|された|される|してい|している|から|まで|より|です|ます|した|して|する|され|いくつ|いくら|この|その|には|では|とは|れた|ある|いる|いて|った|って|の|は|が|を|に|で|と|も|か|へ|や|れ|た|て|い|う|る|な|き|し|く|っ|さ|あ|ま|す|つ|ら)+")
CJK = "぀-ヿ㐀-鿿豈-﫿"
TOKEN = re.compile(r"[ァ-ヿー]+|[㐀-鿿豈-﫿]|[぀-ゟ]+|[^\W_぀-ヿ㐀-鿿豈-﫿]+")
HIRAGANA = re.compile(r"[぀-ゟ]")
WRAPPED = re.compile(r"<img>.*?</img>|</?[a-z_]+>|^\W*(?:q|question|frage|pregunta)\s*:|\banswer\s*:\W*$|^\W*look at the image and reply\.|\breply with one short phrase\b\W*$", re.S)
SIZES = "128|160|224|240|256|320|336|448|480|512|600|640|720|768|800|896|960|1024|1080|1200|1280|1600|1920|2048"


def picture_key(path):
    """Column: the file name without folder, extension, case and marks of size; page marks stay."""
    name = F.lower(F.regexp_extract(F.regexp_replace(F.trim(path), r"[?#].*$", ""), r"([^/\\]*)$", 1))
    name = F.regexp_replace(name, r"\.[a-z0-9]{2,5}$", "")
    mark = rf"(?:@\d+x|[_-]\d{{2,5}}x\d{{2,5}}|[_-](?:thumb|thumbnail|small|medium|large|orig|original|full|preview|hd)|[_-](?:{SIZES})(?:px|w|h)?)+$"
    name = F.regexp_replace(name, rf"(?<=.){mark}", "")
    return F.when(name != "", name)


def question_tokens(text: str) -> list[str]:
    """Words of a question, in order: case, width, accents, punctuation, clitics and wrapper are gone."""
    text = unicodedata.normalize("NFKC", text).casefold()
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    for _ in range(3):
        bare = WRAPPED.sub(" ", text).strip()
        if bare == text:
            break
        text = bare
    text = CLITIC.sub(" ", MEASURE.sub("", text))
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")
    out = []
    for t in TOKEN.findall(unicodedata.normalize("NFC", plain)):
        if HIRAGANA.match(t):
            out += KANA_ASKED.findall(t) if KANA.fullmatch(KANA_ASKED.sub("", t) or "の") else [t]
        else:
            out.append(t)
    return out


def content(tokens: Sequence[str]) -> list[str]:
    """The words that a question is known by: without closed classes, inflected forms as one."""
    out = []
    for t in tokens:
        if t not in FUNCTION:
            t = SAME.get(t, t)
            out.append(ENDING.sub("", t) if len(t) > 4 else t)
    return out


def same_order(a: Sequence[str], b: Sequence[str]) -> bool:
    """Of two orders of the same words: whether they are one, or one phrase has moved, or a phrase and one with a number have changed places."""
    a, b = list(a), list(b)
    if a == b:
        return True
    start, end = 0, len(a)
    while a[start] == b[start]:
        start += 1
    while a[end - 1] == b[end - 1]:
        end -= 1
    x, y = a[start:end], b[start:end]
    if any(x[k:] + x[:k] == y for k in range(1, len(x))):
        return True
    numbered = [any(c.isdigit() for c in w) for w in x]
    return any(x[j:] + x[i:j] + x[:i] == y and any(numbered[:i]) != any(numbered[j:]) for i in range(1, len(x)) for j in range(i + 1, len(x)))


def _tokens_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    tokens = [question_tokens(q) for q in batch.column(0).to_pylist()]
    yield pa.record_batch([batch.column(0), batch.column(1), pa.array(tokens, pa.list_(pa.string()))], ["question", "n", "tokens"])


def slip(wrong: str, right: str) -> bool:
    """Whether only swapped neighbours, dropped or doubled letters divide two words, two of them at most."""

    def steps(a: str, b: str, left: int, gone: str = "") -> bool:
        """gone: the side that has just lost a letter here; two letters lost side by side are no slip."""
        i = 0
        while i < len(a) and i < len(b) and a[i] == b[i]:
            i += 1
        a, b, gone = a[i:], b[i:], "" if i else gone
        if a == b:
            return True
        if left == 0:
            return False
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0] and steps(a[2:], b[2:], left - 1):
            return True
        return bool(b and gone != "b" and steps(a, b[1:], left - 1, "b")) or bool(a and gone != "a" and steps(a[1:], b, left - 1, "a"))

    return abs(len(wrong) - len(right)) <= 2 and (steps(wrong, right, 1) or (max(len(wrong), len(right)) >= 7 and steps(wrong, right, 2)))


def _variants(word: str, depth: int) -> set[str]:
    found, last = {word}, {word}
    for _ in range(depth):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found |= last
    return found


def _variants_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    of, variants = [], []
    for i, word in enumerate(batch.column(0).to_pylist()):
        for v in _variants(word, 2 if len(word) >= 7 else 1):
            of.append(i)
            variants.append(v)
    if of:
        words = batch.take(pa.array(of))
        yield pa.record_batch([*words.columns, pa.array(variants)], ["word", "df", "texts", "variant"])


@F.pandas_udf(T.BooleanType())
def is_slip(a, b):
    import pandas as pd

    return pd.Series([slip(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def in_order(a, b):
    import pandas as pd

    return pd.Series([same_order(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def fixes(tokens: DataFrame) -> DataFrame:
    """word -> right (what it was meant to be, or null) and links (names of the pairs of seldom words one slip apart that it is in).

    `tokens` has question, tokens and n, the number of its rows. Words are counted in rows for what is meant, and in
    distinct questions for what is seldom: a slip stands in one question, however often that is delivered again. The words
    that share a deletion variant are bounded by the letters that can be put into it, whatever the size of the corpus.
    """
    words = tokens.select(F.explode(F.array_distinct("tokens")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("texts"))
    variants = map_arrow(words.where(F.col("word").rlike(rf"^[^\d{CJK}]{{3,}}$")), _variants_batch, "word string, df long, texts long, variant string")
    other = variants.select(F.col("word").alias("right"), F.col("df").alias("right_df"), F.col("texts").alias("right_texts"), "variant")
    near = (
        variants.join(other, "variant")
        .where((F.col("word") != F.col("right")) & ((F.col("df") * RATIO <= F.col("right_df")) | (F.least("texts", "right_texts") <= 2)))
        .groupBy("word", "right")
        .agg(F.first("df").alias("df"), F.first("right_df").alias("right_df"))
        .where(is_slip("word", "right"))
    )
    meant = F.when(F.col("df") * RATIO <= F.col("right_df"), F.struct(-F.levenshtein("word", "right"), "right_df", "right"))
    link = F.when(F.greatest("df", "right_df") < RATIO * F.least("df", "right_df"), F.concat(F.least("word", "right"), F.lit("~"), F.greatest("word", "right")))
    return near.groupBy("word").agg(F.max(meant)["right"].alias("right"), F.array_sort(F.collect_set(link)).alias("links"))


CANON = "question string, coded boolean, keys array<struct<key:string,side:int,words:array<string>>>"
CODE = re.compile(r"[a-z]{1,3}\d{2,}|[a-z]\d+")


def _canon_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    coded, keys = [], []
    for tokens, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        right = {h["word"]: h["right"] for h in hits or () if h["right"]}
        links = {h["word"]: h["links"] for h in hits or () if not h["right"] and h["links"]}
        mended = [right.get(t, t) for t in tokens]
        words = content(mended)
        coded.append(any(CODE.fullmatch(w) for w in words))
        own = [{"key": " ".join(sorted(words)), "side": -1, "words": words}] if words else []
        for word in dict.fromkeys(w for w in mended if w in links and w not in FUNCTION):
            for name in links[word]:
                as_one = content([name if t == word else t for t in mended])
                own.append({"key": " ".join(sorted(as_one)), "side": int(name.startswith(word + "~")), "words": as_one})
        keys.append(own)
    yield pa.record_batch([batch.column(0), pa.array(coded), pa.array(keys, pa.list_(pa.struct([("key", pa.string()), ("side", pa.int32()), ("words", pa.list_(pa.string()))])))], ["question", "coded", "keys"])


def canonical_questions(questions: DataFrame) -> DataFrame:
    """question, n -> question, coded, keys: its canonical words and their bag, and those with a seldom word and its neighbour as one."""
    tokens = cut(map_arrow(questions, _tokens_batch, "question string, n long, tokens array<string>"))
    known = fixes(tokens)
    hits = tokens.select("question", F.explode(F.array_distinct("tokens")).alias("word")).join(known, "word").groupBy("question").agg(F.collect_list(F.struct("word", "right", "links")).alias("hits"))
    return map_arrow(tokens.join(hits, "question", "left").select("question", "tokens", "hits"), _canon_batch, CANON)


def overlaps(df: DataFrame) -> DataFrame:
    """train_id, eval_id: every pair of a train and a val or test record that ask the same of the same picture."""
    rows = df.select(
        F.col("record_id").cast("long").alias("record_id"),
        (F.lower(F.trim("split")) == "train").alias("train"),
        picture_key(F.col("image_path")).alias("picture"),
        "question",
    ).where(F.col("question").isNotNull() & F.lower(F.trim("split")).isin("train", "val", "test"))
    canon = canonical_questions(rows.groupBy("question").agg(F.count(F.lit(1)).alias("n")))
    # how a record may be met: by its picture; without one by any such record, and by one with a picture if coded
    alone = F.col("picture").isNull()
    means = F.when(~alone & F.col("coded"), F.array(F.lit("picture"), F.when(F.col("train"), "coded, alone").otherwise("alone, coded"))).when(~alone, F.array(F.lit("picture")))
    means = F.coalesce(means, F.array(F.lit("alone"), F.when(F.col("train"), "alone, coded").otherwise("coded, alone")))
    mark = F.when(F.col("k.side") < 0, "").when(F.col("train"), F.concat(F.lit("~"), F.col("k.side").cast("string"))).otherwise(F.concat(F.lit("~"), (1 - F.col("k.side")).cast("string")))
    met = rows.join(canon, "question").select("record_id", "train", "picture", F.explode(means).alias("by"), "keys").select("*", F.explode("keys").alias("k"))
    place = F.when(F.col("by") == "picture", F.col("picture")).otherwise("")
    keyed = cut(met.select("record_id", "train", "by", place.alias("place"), F.concat(F.col("k.key"), mark).alias("bag"), "k.words").withColumn("h", F.xxhash64("by", "place", "bag")))
    keys = ["h", "by", "place", "bag"]
    train = keyed.where("train").select(F.col("record_id").alias("train_id"), *keys, F.col("words").alias("train_words"))
    held = keyed.where("not train").select(F.col("record_id").alias("eval_id"), *keys, F.col("words").alias("eval_words"))
    return train.join(held, keys).where(in_order("train_words", "eval_words")).select("train_id", "eval_id")


def found(df: DataFrame) -> DataFrame:
    pairs = overlaps(df)
    return pairs.select(F.least("train_id", "eval_id").alias("record_a"), F.greatest("train_id", "eval_id").alias("record_b"))


def by_split_and_source(df: DataFrame) -> DataFrame:
    """Evaluation records that recur in train, and their pairs, by split and source of the evaluation record."""
    per = overlaps(df).groupBy("eval_id").agg(F.count(F.lit(1)).alias("n"))
    held = df.where(F.lower(F.trim("split")).isin("val", "test")).select(F.col("record_id").cast("long").alias("eval_id"), F.lower(F.trim("split")).alias("split"), source_key(F.col("source")).alias("source"))
    return held.join(per, "eval_id", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
