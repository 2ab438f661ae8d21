"""Packing, overlaps, truncation and pair defects on small rows, against brute force and held-out cuts."""

import itertools
import random

import numpy as np
import pytest

from tesserae.llm import overlap, packing, pairs, refusals, truncation
from tesserae.llm.crf import ChainCRF
from tesserae.llm.learn import fit_logistic, scores

TURNS = "array<struct<from_role:string,value:string>>"


def test_reach_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        target = rng.randint(0, 30)
        items = [x for x, n in counts.items() for _ in range(n)]
        want = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= target)
        best, uses = packing.reach(counts, target)
        assert best == want == sum(x * n for x, n in uses.items())
        assert all(n <= counts[x] for x, n in uses.items())


def test_plan_uses_every_record():
    rng = random.Random(2)
    lengths = [rng.randint(1, 64) for _ in range(500)]
    made = packing.plan({x: lengths.count(x) for x in set(lengths)}, 64)
    used = {}
    for times, fill, uses in made:
        assert fill == sum(x * n for x, n in uses.items()) <= 64
        for x, n in uses.items():
            used[x] = used.get(x, 0) + n * times
    assert used == {x: lengths.count(x) for x in set(lengths)}
    least = max(-(-sum(lengths) // 64), sum(x > 32 for x in lengths))  # no packing has fewer
    assert sum(t for t, *_ in made) <= least * 1.03


def test_sequences(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, -1, 0, 40_000, 700, 700, 700, 90, 2500]), None if i % 50 == 0 else [("human", "Hi")], None, None) for i in range(400)]
    c = spark.createDataFrame(rows, f"row_id long, length int, conversations {TURNS}, image array<string>, video string")
    b = spark.createDataFrame([("s", 1000), ("l", 4000)], "budget_name string, capacity int")
    got = packing.sequences(c, b).collect()
    for name, capacity in (("s", 1000), ("l", 4000)):
        own = [r for r in got if r["budget_name"] == name]
        assert {r["row_id"] for r in own} == set(range(400))
        bins = {}
        for r in own:
            bins.setdefault(r["seq_id"], []).append(r)
        for items in bins.values():
            assert sum(r["n_tokens"] for r in items) == items[0]["fill"] <= capacity
        assert sorted(bins) == list(range(len(bins)))
        for row in range(400):
            parts = [r["n_tokens"] for r in own if r["row_id"] == row]
            assert len(parts) == 1 or all(p == capacity for p in sorted(parts)[1:])
    assert packing.sequences(c.where("false"), b).count() == 0


def test_buckets_grow_with_the_records():
    assert packing.buckets(0) == packing.buckets(1_000_000) == 64
    assert all(n / packing.buckets(n) <= packing.BUCKET_ROWS for n in (10**6, 10**8, 3 * 10**9, 10**12))


def test_long_lengths_are_divided(spark):
    c = spark.createDataFrame([(1, 39_500, [("human", "Hi")], None, None), (2, 300, [("human", "Hi")], None, None), (3, -100, [("human", "Hi")], None, None)], f"row_id long, length int, conversations {TURNS}, image array<string>, video string")
    b = spark.createDataFrame([("l", 8192)], "budget_name string, capacity int")
    got = packing.sequences(c, b).collect()
    assert sorted(r["n_tokens"] for r in got if r["row_id"] == 1) == [39_500 - 4 * 8192] + [8192] * 4
    assert {r["row_id"]: r["estimated"] for r in got} == {1: False, 2: False, 3: True}


def test_slips():
    assert all(overlap.slip(a, b) for a, b in (("numebr", "number"), ("amunt", "amount"), ("formulaaire", "formulaire"), ("forumlaiire", "formulaire")))
    assert not any(overlap.slip(a, b) for a, b in (("velsun", "relsun"), ("bars", "bottles"), ("calosnix", "calnix"), ("left", "right")))


def test_other_questions_stay_other(spark):
    """Order, single letters, months and adjectives make another question; a moved phrase doesn't."""
    pairs_ = [
        ("What is the value at point C?", "What is the value at point D?", False),
        ("Is the cup left of the plate?", "Is the plate left of the cup?", False),
        ("Are there more cats than dogs?", "Are there more dogs than cats?", False),
        ("What is the total for May?", "What is the total?", False),
        ("Where is the large dog?", "Where is the dog?", False),
        ("What is the total for May?", "For May, what is the total?", True),
        ("Welchen Wert hat Briith im Jahr 1998?", "Im Jahr 1998 hat Briith welchen Wert?", True),
        ("Is it 12:30 or 13:20?", "Is it 13:20 or 12:30?", False),
        ("りんごはいくつありますか？", "みかんはいくつありますか？", False),
        ("How big is the difference between 2012 and 2014 for Zornix?", "What's the difference between 2012 and 2014 for Zornix?", True),
        ("Who signed the form of Lumquin?", "Who signed the form of Lumqiun?", True),
        ("Who signed the form of Calosnix?", "Who signed the form of Calnix?", False),
    ]
    rows = [r for i, (a, b, _) in enumerate(pairs_) for r in ((2 * i, "train", f"p_{i}a.jpg", a), (2 * i + 1, "val", f"p_{i}a.jpg", b))]
    df = spark.createDataFrame(rows, "record_id long, split string, image_path string, question string")
    got = {r["record_a"] // 2 for r in overlap.found(df).collect()}
    assert got == {i for i, (_, _, same) in enumerate(pairs_) if same}


def test_found_overlaps(spark):
    rows = [
        (1, "train", "d/a_11aa_p1.jpg", "How many bars are visible on the left side?"),
        (2, "val", "x\\A_11AA_P1@2x.PNG", "On the left side, how many bars can be seen?"),
        (3, "val", "a_11aa_p2.jpg", "How many bars are visible on the left side?"),
        (4, "test", "a_11aa_p1.jpg", "How many bars are visible on the right side?"),
        (5, "test", "a_11aa_p1_1024x768.webp", "<image>\nHOW MANY BARS ARE VISIBLE ON THE LEFT SIDE?\nReply with one short phrase."),
        (6, "train", "b.jpg", "Who issued form Z１２３?"),
        (7, "test", None, "Form Z123 was issued by whom?"),
        (8, "test", None, "Who issued form Z124?"),
        (9, "train", "c_1.jpg", "What colour is the bar for Lumquin?"),
        (10, "val", "c_1.jpg", "What colour is the bar for Lumqiun?"),
        (11, "val", "c_1.jpg", "What colour is the bar for Velquin?"),
        (12, "train", None, None),
        (13, "val", None, None),
        (2, "val", "x\\A_11AA_P1@2x.PNG", "On the left side, how many bars can be seen?"),
        (14, "other", "b.jpg", "Who issued form Z123?"),
    ]
    df = spark.createDataFrame([(*r, "s", "q") for r in rows], "record_id long, split string, image_path string, question string, source string, bag string")
    got = sorted((r["record_a"], r["record_b"]) for r in overlap.found(df).collect())
    assert got == [(1, 2), (1, 2), (1, 5), (6, 7), (9, 10)]
    assert overlap.found(df.where("split <> 'train'")).count() == 0
    report = overlap.by_split_and_source(df).collect()
    assert sum(r["pairs"] for r in report) == 5 * 1 + 2  # the redelivered row counts for both of its rows


def test_logistic_learns():
    rng = np.random.default_rng(0)
    rows = [[int(x), 100] for x in rng.integers(0, 50, 4000)]
    y = [int(r[0] < 25) for r in rows]
    w = fit_logistic(rows, y)
    assert ((scores(w, rows) > 0) == np.array(y)).mean() > 0.99
    assert not fit_logistic([], []).any()


def test_crf_marginals_and_path_are_brute_force():
    rng = np.random.default_rng(1)
    field = ChainCRF("abc")
    field.step, field.begin = rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    unary = rng.normal(size=(4, 3))
    paths = list(itertools.product(range(3), repeat=4))
    weight = {p: field.begin[p[0]] + sum(unary[t, k] for t, k in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths}
    total = sum(np.exp(w) for w in weight.values())
    single, pair = field.marginals(unary)
    for t in range(4):
        for k in range(3):
            assert single[t, k] == pytest.approx(sum(np.exp(w) for p, w in weight.items() if p[t] == k) / total, rel=1e-5)
    assert pair.sum() == pytest.approx(3, rel=1e-5)
    assert tuple(field.best(unary)) == max(weight, key=weight.get)


SENTENCES = ["The picture shows a {} near the {}.", "There are {} {}s on the table.", "A {} stands behind the {}, and the light is on.", "The {} is next to the {}."]
NOUNS = "kettle ladder bench window lantern receipt column table bowl corner".split()


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(SENTENCES).format(rng.choice(NOUNS), rng.choice(NOUNS)) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_held_out_cuts():
    w = truncation.fit([(t, "gpt") for t in texts(1500, 1)])
    rng = random.Random(2)
    whole = texts(300, 3)
    cut = [t[: rng.randint(12, len(t) - 4)].rstrip(". ") for t in whole]
    kinds = ["gpt"] * 300
    assert truncation.score_texts(whole, kinds, [None] * 300, w).mean() < 0.02
    assert truncation.score_texts([t.rstrip(".") for t in whole], kinds, [None] * 300, w).mean() < 0.05
    assert truncation.score_texts(cut, kinds, [None] * 300, w).mean() > 0.85
    assert not truncation.score_texts(["", " ", "...", "N/A", "19", "Keep dry", "<answer></answer>", "�"], ["gpt"] * 8, [None] * 8, w).any()


def test_truncation_rows(spark):
    c = spark.createDataFrame([(i, "s", [("system", "cut of"), ("human", t), ("gpt", t[:30] + " [truncated]"), ("gpt", None)]) for i, t in enumerate(texts(300, 5))], f"row_id long, source string, conversations {TURNS}").selectExpr("*", "1 as text")
    p = spark.createDataFrame([(1, "s", "The kettle is next to the ben"), (2, "s", None), (3, None, "")], "pred_id long, source string, answer string")
    got = {(r["tbl"], r["rec_key"], r["turn_no"]) for r in truncation.found(c, p).collect()}
    assert ("prediction", 1, -1) in got and len([g for g in got if g[0] == "conversation" and g[2] == 2]) > 280
    assert not [g for g in got if g[2] in (0, 1)]
    assert truncation.found(c.where("false"), p.where("false")).count() == 0


def test_limits_stand_out(spark):
    rng = random.Random(4)

    def word(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    rows = [("short", word(min(rng.randint(5, 90), 72))) for _ in range(400)] + [("short", word(140))]
    rows += [("free", word(rng.randint(5, 90))) for _ in range(400)] + [("free", "b" * 150)] * 4  # redelivered
    rows += [("dates", f"2021-{m:02}-{d:02}") for m in range(1, 13) for d in range(1, 29)]
    rows += [("yes", rng.choice(["yes", "no"])) for _ in range(400)]
    rows += [("rare", word(rng.randint(5, 90))) for _ in range(5000)] + [("rare", word(200)) for _ in range(4)]
    prediction = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "pred_id long, source string, answer string")
    none = spark.createDataFrame([], f"row_id long, source string, conversations {TURNS}")
    sizes = truncation.lengths(none, prediction)
    assert sum(r["n"] for r in sizes.collect()) == len(rows)
    caps = truncation.limits(sizes)
    assert [(r["source"], r["caps"]) for r in caps.collect()] == [("short", [72])]
    texts = truncation.prediction_texts(prediction)
    want = sorted((i, 72 - len(t)) for i, (s, t) in enumerate(rows) if s == "short" and len(t) <= 72)
    for few in (10, 0):  # broadcast, and dealt among parts
        got = truncation.with_room(texts, caps, "text", few).where("room is not null")
        assert sorted((r["rec_key"], r["room"]) for r in got.collect()) == want


#: Refusals in words that no composed one has; none of them stands in the tables.
HELD_OUT = {
    "en": ["That is a topic I stay away from.", "No comment.", "I don't do image questions.", "I'll have to leave that one to others.", "Talking about this is off limits for me.", "My rules keep me from saying anything here.", "It isn't my place to judge this photo.", "I was not built for describing pictures.", "I shall refrain from replying."],
    "de": ["Dazu schweige ich.", "Ich bin nicht befugt, darüber Auskunft zu geben.", "Das geht über meine Möglichkeiten hinaus."],
    "fr": ["Je ne suis pas habilité à traiter ce sujet.", "Cela ne relève pas de mes compétences."],
    "es": ["No estoy en condiciones de opinar sobre esto.", "Eso no lo puedo contestar."],
    "zh": ["这个我不方便说。", "请原谅，我没有资格评论这张照片。", "该内容不在我的服务范围内。"],
    "ja": ["それについてはお話しできません。", "恐縮ですが、この写真の説明は控えさせてください。"],
}
REAL = ["Sorry for the earlier slip: there are 12 lamps near the window.", "I cannot see any birds here because the street is empty, so the count is 0.", 'The letter says "I am unable to accept your offer" and is signed.', "The light comes from one side, so a kettle throws a long shadow.", "Keep dry", "orange"]


def test_refusals_in_unseen_words():
    """The field learns refusals from composed ones alone; here it meets wordings that none of them has."""
    told = texts(1200, 8)
    weights = truncation.fit([(t, "gpt") for t in told])
    samples = [("What can be seen in the picture?", t) for t in told] + [("How many are there?", f"There are {i} lamps.") for i in range(300)]
    rng = random.Random(6)
    samples += [("How many are there?", f"I cannot see any {rng.choice(NOUNS)}s there because the room is dark, so the count is {i % 3}.") for i in range(60)]
    samples += [("How many are there?", f"Sorry for the slip: there are {i} {rng.choice(NOUNS)}s.") for i in range(60)]
    samples += [("What does it say?", f'The {rng.choice(NOUNS)} says "I am unable to {rng.choice(["help", "answer", "come"])}".') for i in range(60)]
    samples += [("What is it?", rng.choice(NOUNS) if i % 2 else f"{rng.choice(NOUNS)} {rng.choice(NOUNS)}") for i in range(200)]
    languages = pairs.Languages.fit([(t, "en") for t in told] + [(refusals.composed(c, random.Random(i), None), c) for c in ("de", "fr", "es", "zh", "ja") for i in range(300)])
    tagger = pairs.learn_field(samples, pairs.Tagger(ChainCRF(pairs.LABELS), languages, weights))
    prompt = {"en": "What can be seen in the picture?"}
    for code, wordings in HELD_OUT.items():
        found = [w for w in wordings if tagger.defect(prompt.get(code), w, False) == "refusal"]
        assert len(found) >= 0.85 * len(wordings), (code, set(wordings) - set(found))
    assert [(t, found) for t in REAL if (found := tagger.defect(prompt["en"], t, False)) is not None] == []


@pytest.mark.parametrize(
    ("prompt", "response", "want"),
    [("Where is it?", "WHERE IS IT", True), ("Where is a red bench?", "Where is a rd bench?", True), ("Count the birds.", "Count the birds. Count the birds.", True), ("这张图里有什么？", "问题：这张图里有什么？\n=>", True), ("Where is it?", "Where it is you see a door.", False), ("Is it red?", "It is red.", False)],
)
def test_copied(prompt, response, want):
    assert pairs.copied(prompt, response) is want


def test_pair_rows(spark):
    en = texts(400, 7)
    de = ["Das Bild zeigt eine Bank neben dem Fenster und eine Lampe auf dem Tisch."] * 200
    rows = [(i, "en", [("human", "What can be seen in the picture?"), ("gpt", t)]) for i, t in enumerate(en)] + [(1000 + i, "de", [("human", "Was ist auf dem Bild zu sehen?"), ("gpt", t)]) for i, t in enumerate(de)]
    rows += [
        (5000, "en", [("human", "What can be seen in the picture?"), ("gpt", "I'm sorry, but I can't help with that.")]),
        (5001, "en", [("system", "x"), ("human", "What can be seen in the picture?"), ("gpt", "[blank]")]),
        (5002, "en", [("human", "What can be seen in the picture?"), ("gpt", "what can be seen in the picture")]),
        (5003, "en", [("human", "What can be seen in the picture?"), ("gpt", de[0])]),
        (5004, "en", [("human", "Describe the picture in German."), ("gpt", de[0])]),
        (5005, "en", [("human", "What can be seen in the picture?"), ("gpt", 'The sign reads "Sorry, we cannot open today" near the window.')]),
        (5006, "en", [("gpt", "Hello"), ("human", None), ("gpt", None)]),
        (5007, "en", None),
    ]
    c = spark.createDataFrame([(i, "s", lang, t) for i, lang, t in rows], f"row_id long, source string, lang string, conversations {TURNS}")
    q = spark.createDataFrame([(1, "s", "val", "1", "Where is the kettle?", ["here"], "en"), (2, "s", "val", "1", "Where is the kettle?", ["here"], "en")], "record_id long, source string, split string, question_id string, question string, answer array<string>, lang string")
    p = spark.createDataFrame([(1, "s", "val", "1", "where is the kettle"), (2, "s", "val", "9", de[0]), (3, "s", "val", None, None)], "pred_id long, source string, split string, question_id string, answer string")
    got = {(r["rec_key"], r["turn_no"]): r["defect"] for r in pairs.found(c, p, q).collect()}
    assert got == {(5000, 1): "refusal", (5001, 2): "empty_answer", (5002, 1): "copied_question", (5003, 1): "wrong_language", (5006, 2): "empty_answer", (1, -1): "copied_question", (3, -1): "empty_answer"}
