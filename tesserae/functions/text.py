"""String scalars of answer scoring, as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation marks of the consensus scorer.
PUNCTUATION = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]
#: Number words and articles of the consensus scorer.
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]
#: Contractions of the consensus scorer, as written and as meant.
CONTRACTIONS = {
    "aint": "ain't",
    "arent": "aren't",
    "cant": "can't",
    "couldve": "could've",
    "couldnt": "couldn't",
    "couldn'tve": "couldn't've",
    "couldnt've": "couldn't've",
    "didnt": "didn't",
    "doesnt": "doesn't",
    "dont": "don't",
    "hadnt": "hadn't",
    "hadnt've": "hadn't've",
    "hadn'tve": "hadn't've",
    "hasnt": "hasn't",
    "havent": "haven't",
    "hed": "he'd",
    "hed've": "he'd've",
    "he'dve": "he'd've",
    "hes": "he's",
    "howd": "how'd",
    "howll": "how'll",
    "hows": "how's",
    "Id've": "I'd've",
    "I'dve": "I'd've",
    "Im": "I'm",
    "Ive": "I've",
    "isnt": "isn't",
    "itd": "it'd",
    "itd've": "it'd've",
    "it'dve": "it'd've",
    "itll": "it'll",
    "let's": "let's",
    "maam": "ma'am",
    "mightnt": "mightn't",
    "mightnt've": "mightn't've",
    "mightn'tve": "mightn't've",
    "mightve": "might've",
    "mustnt": "mustn't",
    "mustve": "must've",
    "neednt": "needn't",
    "notve": "not've",
    "oclock": "o'clock",
    "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at",
    "'ows'at": "'ow's'at",
    "'ow'sat": "'ow's'at",
    "shant": "shan't",
    "shed've": "she'd've",
    "she'dve": "she'd've",
    "she's": "she's",
    "shouldve": "should've",
    "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've",
    "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd",
    "somebodyd've": "somebody'd've",
    "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll",
    "somebodys": "somebody's",
    "someoned": "someone'd",
    "someoned've": "someone'd've",
    "someone'dve": "someone'd've",
    "someonell": "someone'll",
    "someones": "someone's",
    "somethingd": "something'd",
    "somethingd've": "something'd've",
    "something'dve": "something'd've",
    "somethingll": "something'll",
    "thats": "that's",
    "thered": "there'd",
    "thered've": "there'd've",
    "there'dve": "there'd've",
    "therere": "there're",
    "theres": "there's",
    "theyd": "they'd",
    "theyd've": "they'd've",
    "they'dve": "they'd've",
    "theyll": "they'll",
    "theyre": "they're",
    "theyve": "they've",
    "twas": "'twas",
    "wasnt": "wasn't",
    "wed've": "we'd've",
    "we'dve": "we'd've",
    "weve": "we've",
    "werent": "weren't",
    "whatll": "what'll",
    "whatre": "what're",
    "whats": "what's",
    "whatve": "what've",
    "whens": "when's",
    "whered": "where'd",
    "wheres": "where's",
    "whereve": "where've",
    "whod": "who'd",
    "whod've": "who'd've",
    "who'dve": "who'd've",
    "wholl": "who'll",
    "whos": "who's",
    "whove": "who've",
    "whyll": "why'll",
    "whyre": "why're",
    "whys": "why's",
    "wont": "won't",
    "wouldve": "would've",
    "wouldnt": "wouldn't",
    "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've",
    "yall": "y'all",
    "yall'll": "y'all'll",
    "y'allll": "y'all'll",
    "yall'd've": "y'all'd've",
    "y'alld've": "y'all'd've",
    "y'all'dve": "y'all'd've",
    "youd": "you'd",
    "youd've": "you'd've",
    "you'dve": "you'd've",
    "youll": "you'll",
    "youre": "you're",
    "youve": "you've",
}
#: Blanks of any script, as a class.
BLANK = r"[\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
MARKS = "".join(PUNCTUATION)
#: Periods that the scorer takes away at most.
PERIODS = 32
WORD_NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "dozen", "hundred", "thousand"]


def strip(c: Column) -> Column:
    """All whitespace at both ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, also within the functions of arrays, where plans have no place for it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def near_distance(a: Column, b: Column, length: Column) -> Column:
    """Edit distance by code points where it is at most half the length; the length itself where it is more.

    Distances beyond half score nothing, so the search stops there and looks at no text that is too long or too short.
    """
    half = F.floor(length / 2).cast("int")
    found = F.when(F.abs(F.length(a) - F.length(b)) > half, F.lit(-1)).otherwise(F.call_function("levenshtein", a, b, half))
    return F.when(found < 0, length).otherwise(found)


def norm_anls(gold: Column, pred: Column) -> Column:
    """Edit distance of the stripped, lower-case strings over the longer raw length; 1 if beyond half of it, 0 for two empty strings."""
    length = F.greatest(F.length(gold), F.length(pred))
    return F.when(length == 0, F.lit(0.0)).otherwise(near_distance(strip(F.lower(gold)), strip(F.lower(pred)), length) / length)


def anls(golds: Column, pred: Column, threshold: float = 0.5) -> Column:
    """1 - smallest normalised distance, 0 below the threshold."""
    s = 1.0 - F.array_min(F.transform(golds, lambda g: norm_anls(g, pred)))
    return F.when(s < threshold, 0.0).otherwise(s)


def process_punctuation(c: Column) -> Column:
    """A mark that stands next to a blank anywhere, or any mark in a text with digit,digit, goes away; otherwise it becomes a blank."""
    one = "[" + "".join("\\" + m for m in PUNCTUATION) + "]"
    beside = F.array_join(F.regexp_extract_all(c, F.lit(f"{one}(?= )|(?<= ){one}"), F.lit(0)), "")
    gone = F.when(c.rlike(r"\p{Nd},\p{Nd}"), MARKS).otherwise(beside)
    kept = F.call_function("translate", F.lit(MARKS), gone, F.lit(""))
    # what has no counterpart goes away
    return period_strip(F.call_function("translate", c, F.concat(kept, gone), F.repeat(F.lit(" "), F.length(kept))))


def period_strip(c: Column, most: int = PERIODS) -> Column:
    """Without the first `most` periods that are not before a digit."""
    return F.array_join(F.split(c, r"\.(?!\p{Nd})", most + 1), "")


def digit_article(c: Column) -> Column:
    """Lower case, number words as digits, no articles, contractions with their apostrophe."""
    number, contraction = (F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) for t in (NUMBER_WORDS, CONTRACTIONS))
    said = F.transform(F.filter(F.split(F.lower(c), f"{BLANK}+"), lambda w: w != ""), lambda w: F.coalesce(number[w], w))
    return F.array_join(F.transform(F.filter(said, lambda w: ~w.isin(ARTICLES)), lambda w: F.coalesce(contraction[w], w)), " ")


def flat(c: Column) -> Column:
    """Line ends and tabs as blanks, none at the ends."""
    return strip(F.regexp_replace(c, r"[\n\t]", " "))


def consensus_form(c: Column) -> Column:
    """An answer's normal form in the consensus scorer."""
    return let(flat(c), lambda x: digit_article(process_punctuation(x)))


def answer_processor(c: Column) -> Column:
    """An answer's normal form where commas, question marks and the genitive are taken apart first."""
    first = F.replace(F.replace(F.replace(F.lower(c), F.lit(","), F.lit("")), F.lit("?"), F.lit("")), F.lit("'s"), F.lit(" 's"))
    return consensus_form(strip(first))


def gqa_clean(c: Column) -> Column:
    """Cut at the first mark; after is, are and articles the piece behind them, before of the piece ahead; by substrings."""
    for mark in (".", ",", "!"):
        c = F.substring_index(c, mark, 1)
    for lead in ("is ", "are ", "a ", "an ", "the "):  # the second piece, or the only one
        c = F.element_at(F.slice(F.split(c, f"\\Q{lead}\\E"), 1, 2), -1)
    return strip(F.substring_index(c, " of", 1))


def option_post_process(pred: Column, options: Column) -> Column:
    """A letter as it is; else the first letter if it is an option's; else the first option whose text is contained; else the text."""
    p = strip(pred)
    hit = F.try_element_at(F.filter(options, lambda o: F.contains(p, o["text"])), F.lit(1))
    first = F.substring(p, 1, 1)
    return F.when(F.length(p) == 1, p).when(F.exists(options, lambda o: o["key"] == first), first).otherwise(F.coalesce(hit["key"], p))


def yes_no(c: Column) -> Column:
    """Cut at the first period, commas away; no if one of the words is No, not or no; else yes."""
    head = F.replace(F.substring_index(c, ".", 1), F.lit(","), F.lit(""))
    return F.when(F.arrays_overlap(F.split(head, " "), F.array(F.lit("No"), F.lit("not"), F.lit("no"))), "no").otherwise("yes")


def yes_no_other(c: Column) -> Column:
    """yes or no as the whole, or within the first four characters; else other."""
    low = F.lower(c)
    head = F.substring(low, 1, 4)
    return F.when(low.isin("yes", "no"), low).when(F.contains(head, F.lit("yes")), "yes").when(F.contains(head, F.lit("no")), "no").otherwise("other")


def bilingual_yes_no(c: Column) -> Column:
    """Chinese and English affirmation and denial brought to yes and no; other CJK characters go away."""
    for a, b in (("\n", ""), ("不是", "No"), ("是", "Yes"), ("否", "No")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.lower(c)
    for a, b in (("true", "yes"), ("false", "no")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, "[一-龥]", "")


def extract_numbers(c: Column) -> Column:
    """Numbers with commas, in scientific form and plain, in this order."""
    return F.concat(
        F.regexp_extract_all(c, F.lit(r"-?\b\d{1,3}(?:,\d{3})+\b"), F.lit(0)),
        F.regexp_extract_all(c, F.lit(r"-?\d+(?:\.\d+)?[eE][+-]?\d+"), F.lit(0)),
        F.regexp_extract_all(c, F.lit(r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])"), F.lit(0)),
    )


def remove_special_chars(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")


def contains_word(text: Column, word: Column) -> Column:
    """The word stands in the text between word boundaries."""
    return F.rlike(text, F.concat(F.lit(r"\b\Q"), word, F.lit(r"\E\b")))


def reciprocal_rank(text: Column, candidates: Column) -> Column:
    """1 over the place of the first candidate found as a whole word; 0 if none."""
    at = F.array_position(F.transform(candidates, lambda w: contains_word(text, w)), F.lit(True))
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def judge_scores(c: Column) -> Column:
    """Two numbers on the first line; else -1 and -1."""
    parts = F.split(F.replace(F.substring_index(c, "\n", 1), F.lit(","), F.lit(" ")), " ")
    a, b = (F.element_at(parts, i).try_cast("double") for i in (1, 2))
    fine = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    return F.when(fine, F.array(a, b)).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def strip_tags(c: Column) -> Column:
    """Without point, box, ref and quad tags and what they hold."""
    return F.regexp_replace(c, r"<(box|point|quad)>.*?</(box|point|quad)>|</?(ref|box|point|quad)>", "")


def tagged(c: Column, tag: str) -> Column:
    """The contents of every closed tag, in order."""
    return F.regexp_extract_all(c, F.lit(f"<{tag}>(.*?)</{tag}>"), F.lit(1))


def box_midpoint(c: Column) -> Column:
    """(x1,y1),(x2,y2) to its middle, in whole numbers."""
    n = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(n) >= 4, F.array(F.floor((n[0] + n[2]) / 2).cast("int"), F.floor((n[1] + n[3]) / 2).cast("int")))


def tail(c: Column, share: float = 0.9) -> Column:
    """The last share of a prompt that was too long."""
    kept = F.floor(F.length(c) * share).cast("int")
    return F.substring(c, F.length(c) - kept + 1, kept)
