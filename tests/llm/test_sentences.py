"""Sentence units: hand-made cases in several scripts, the partition property, and the operator over rows."""

import random
import time

import pytest

from tesserae.llm.sentences import sentence_units, units

CASES = [
    ("Dr. Smith met Mrs. Jones vs. Mr. Lee. They left.", ["Dr. Smith met Mrs. Jones vs. Mr. Lee.", "They left."]),
    ("It weighs .7 kg. See Fig. 16 and p. 3.", ["It weighs .7 kg.", "See Fig. 16 and p. 3."]),
    ("The bus leaves at 10 a.m. Monday. The doors close at 8 p.m. Look!", ["The bus leaves at 10 a.m. Monday.", "The doors close at 8 p.m.", "Look!"]),
    ("She lives in the U.S. Nobody knows.", ["She lives in the U.S.", "Nobody knows."]),
    ('The notice says "Keep dry. Ring twice." and is framed. Go.', ['The notice says "Keep dry. Ring twice." and is framed.', "Go."]),
    ('A clerk says, "Wet paint!" The shop opens.', ['A clerk says, "Wet paint!"', "The shop opens."]),
    ("It is red. (The lower part is blurred.) It is blue.", ["It is red.", "(The lower part is blurred.)", "It is blue."]),
    ("The editor (seen from behind, approx. 41.3 m away) waves. Bye.", ["The editor (seen from behind, approx. 41.3 m away) waves.", "Bye."]),
    ("The text fades out ... and then resumes. Stop!! Is it?!", ["The text fades out ... and then resumes.", "Stop!!", "Is it?!"]),
    ("A heading\n\nOne line\nwraps here. Two.", ["A heading", "One line\nwraps here.", "Two."]),
    ("The page lists:\n1. A key. It is old.\n2. A map", ["The page lists:", "1. A key.", "It is old.", "2. A map"]),
    ("User: Where is it?\nAssistant: Here. Look.", ["User: Where is it?", "Assistant: Here.", "Look."]),
    ("Date: No. 34\nTotal: 4.5\n\nEnd.", ["Date: No. 34", "Total: 4.5", "End."]),
    ("园丁问：“是吗？还是？”然后离开了。店员说：“保持干燥！”一共有3张。", ["园丁问：“是吗？还是？”然后离开了。", "店员说：“保持干燥！”", "一共有3张。"]),
    ("“在哪里？”店员问道。文字模糊……随后清晰。", ["“在哪里？”店员问道。", "文字模糊……随后清晰。"]),
    ("Der Plan gilt ab dem 31. Mai 1986. Man sieht z. B. eine Bank.", ["Der Plan gilt ab dem 31. Mai 1986.", "Man sieht z. B. eine Bank."]),
    ("В 1962 г. кривая упала, т. е. меньше. Какая толпа!", ["В 1962 г. кривая упала, т. е. меньше.", "Какая толпа!"]),
    ("बोर्ड पर “दो बार।” लिखा है। कितनी भीड़ है!", ["बोर्ड पर “दो बार।” लिखा है।", "कितनी भीड़ है!"]),
    ("—¿Dónde está? —pregunta un niño. ¡Sí!", ["—¿Dónde está? —pregunta un niño.", "¡Sí!"]),
    ("The page lists:\n999. A key.\n1000. A map. It is old.", ["The page lists:", "999. A key.", "1000. A map.", "It is old."]),
    ("Donaudampfschifffahrtsgesellschaft: Abfahrt. Los.\nEnde.", ["Donaudampfschifffahrtsgesellschaft: Abfahrt.", "Los.", "Ende."]),
    ("Near the door.The light is on.", ["Near the door.", "The light is on."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in units(text)] == want


@pytest.mark.parametrize("text", [None, "", " \n\t ", "\r\n\r\n", "\xa0"])
def test_nothing(text):
    assert units(text) == []


def test_every_other_character_is_in_exactly_one_unit():
    rng = random.Random(4)
    alphabet = list("ab Z.?!\"“”(）)。\n\r:，1「」…—'«»") + ["Dr. ", "\n\n", "- ", "x: ", "\U0001f642"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        seen = 0
        for a, b in units(text):
            assert a >= seen and b > a
            assert text[seen:a].strip() == "" and not text[a].isspace() and not text[b - 1].isspace()
            seen = b
        assert text[seen:].strip() == ""


def test_rows_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Red bus. Go on.", 7), (1, "Red bus. Go on.", 7), (2, None, 1), (3, "", 1), (4, "x " * 200_000, 1)], "doc_id long, text string, start_char int")
    rows = sentence_units(df).collect()
    assert sorted((r["doc_id"], r["start_char"], r["end_char"]) for r in rows) == [(1, 0, 8), (1, 0, 8), (1, 9, 15), (1, 9, 15), (4, 0, 399_999)]
    assert sentence_units(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["(" * 100_000 + "]" * 100_000, "/Ab" + ".Ab" * 100_000, "“" * 50_000 + "»" * 50_000 + " x.", "“ก ข” ภาพนี้ แสดงป้าย " * 20_000])
def test_time_is_linear(text):
    began = time.process_time()
    units(text)
    assert time.process_time() - began < 15
