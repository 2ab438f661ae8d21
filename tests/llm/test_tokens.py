"""Encoding, token counts and mixing against the public libraries and brute force."""

import random

import numpy as np
import pytest

from tesserae.llm import budget, encoding, mixing

TEXTS = ["", " ", "Hello, world's  end\n\n x", "纵轴从2.2上升到23.6。", "naïve café 🙂👩‍🔬", "AAAAAAAAAAAAAAAAAAAA" * 20, "<|endoftext|> it's\r\n\ttab", "स्वागत ที่นี่ أهلا", "a" * 3000, "‮abc‬ \x07 �", "  lead and trail  "]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    pool = "ab cdé.,'s\n\t1290纵轴🙂▁<|>ﬁ½"
    return TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(400)]


def test_encoder_is_the_public_one(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    own = encoding.encoder(encoding.vocabulary_path())
    assert [own.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_perfect_hash_is_minimal_and_tells_misses():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = encoding.PerfectHash(keys, list(range(5000)))
    assert len(table.keys) == 5000 and sorted(table.values) == list(range(5000))
    assert all(table.get(k) == i for i, k in enumerate(keys)) and table.get(b"other") == -1


def test_counter_is_the_public_one(texts):
    import sentencepiece

    path = budget.vocabulary_path()
    own, public = budget.counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert [own.tokens(x) for x in texts] == [len(public.encode(x)) for x in texts]


def test_viterbi_counts_the_best_path():
    pieces, scores = ["a", "b", "ab", "ba", "abb"], [-2.0, -2.5, -3.0, -2.8, -4.4]
    trie = budget.DoubleArray(pieces)
    rng = random.Random(5)

    def brute(text):
        best = {0: (0.0, 0)}
        for i in range(len(text)):
            if i in best:
                for p, s in zip(pieces, scores, strict=True):
                    if text.startswith(p, i):
                        c = (best[i][0] + s, best[i][1] + 1)
                        if i + len(p) not in best or c[0] > best[i + len(p)][0]:
                            best[i + len(p)] = c
        return best[len(text)][1]

    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        assert budget.viterbi_count(text, trie, scores) == brute(text)


def test_encode_corpus_rows(spark):
    df = spark.createDataFrame([(1, "Hi there"), (2, None), (3, ""), (3, "Hi there")], "doc_id long, text string").selectExpr("*", "1 as ids")
    got = sorted((r["doc_id"], r["ids"]) for r in encoding.encode_corpus(df).collect())
    assert got == [(1, [17250, 612]), (2, []), (3, []), (3, [17250, 612])]


def test_budget_rows(spark):
    turn = "array<struct<from_role:string,value:string>>"
    c = spark.createDataFrame([("s1", "EN", [("human", "Hi there"), ("gpt", None)]), ("s1", "en-US", [("gpt", "Hi there")]), (None, None, None), ("S1 ", " en", [])], f"source string, lang string, conversations {turn}")
    p = spark.createDataFrame([("s1", "val", "1", ["yes", None]), ("s1", "val", None, None)], "source string, split string, question_id string, annotation array<string>")
    q = spark.createDataFrame([("s1", "val", "1", 5, "de"), ("s1", "val", "1", 9, "fr")], "source string, split string, question_id string, record_id long, lang string")
    m = spark.createDataFrame([("s1", "chart")], "ds_name string, domain string")
    got = {(r["tbl"], r["source"], r["lang"], r["domain"]): (r["records"], r["texts"], r["tokens"]) for r in budget.token_budget(c, p, q, m).collect()}
    assert got == {("conversation", "s1", "en", "chart"): (3, 2, 4), ("conversation", "unknown", "unknown", "unknown"): (1, 0, 0), ("annotation", "s1", "de", "chart"): (1, 1, 1), ("annotation", "s1", "unknown", "chart"): (1, 0, 0)}


def test_quotas_and_dealing():
    q = mixing.quotas({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.25, 1), "c": (0.25, 9)})
    assert q == {"a": 200, "b": 100}
    dealt = mixing.deal({"a": 37, "b": 500}, 8)
    assert int(dealt["a"].sum()) == 37 and int(dealt["b"].sum()) == 500
    assert np.ptp(dealt["a"] + dealt["b"]) <= 1


def test_mixture_keeps_caps_and_shares(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("word" for _ in range(rng.randint(5, 40))), "a" if i % 3 else "B ") for i in range(1500)] + [(9000 + i, t, "a") for i, t in enumerate([None, "", "word"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeat int")
    got = mixing.repeats(docs, targets).collect()
    assert all(r["repeats"] <= {"a": 1, "b": 3}[r["source"]] and len(r["shards"]) == r["repeats"] for r in got)
    total = {s: sum(r["n_tokens"] * r["repeats"] for r in got if r["source"] == s) for s in "ab"}
    assert total["a"] / (total["a"] + total["b"]) == pytest.approx(1 / 3, abs=0.005)
    again = mixing.repeats(docs, targets).collect()
    assert sorted(map(tuple, ((r["doc_id"], r["repeats"]) for r in got))) == sorted(map(tuple, ((r["doc_id"], r["repeats"]) for r in again)))
    assert mixing.repeats(docs.where("false"), targets).count() == 0


def test_shards_are_shuffled_and_a_total_is_met(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("word" for _ in range(rng.randint(5, 40))), "a" if i % 4 else "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as block", "2 as place")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeat int")
    got = mixing.mixture(docs, targets, shards=6).collect()
    for shard in range(6):
        own = sorted((r["place"], r["doc_id"]) for r in got if r["shard"] == shard)
        assert [p for p, _ in own] == list(range(len(own))) and len(own) > 100
        ids = [d for _, d in own]
        assert abs(sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids) - 0.5) < 0.15  # in no order
    assert len({(r["doc_id"], r["copy_no"]) for r in got}) == len(got)
    small = mixing.shares(docs, targets, total=6000).collect()
    assert all(abs(r["tokens"] - 3000) <= 40 and r["most_repeats"] == 1 for r in small)
    much = {r["source"]: r for r in mixing.shares(docs, targets, total=10**9).collect()}  # the caps decide
    assert {s: r["most_repeats"] for s, r in much.items()} == {"a": 2, "b": 3} and much["a"]["documents"] == 1500
    assert mixing.blocks_of(0) == 16 and mixing.blocks_of(10_000) == 128 and mixing.blocks_of(10**12) == mixing.MOST_BLOCKS
    assert mixing.shards_of(10) == 8 and mixing.shards_of(100 << 20) == 100
