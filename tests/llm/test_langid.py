import random
import zlib

import numpy as np

from lexiloom.llm import langid

LETTERS = {"aa": "abcde", "bb": "cdefghé", "cc": "жзийкл"}


def test_bundles_match_their_definition():
    texts = ["Ab c!", "", "123", "É", "x" * 50]
    made = langid.bundles(texts)
    for text, row in zip(texts, made):
        line = [0]
        for c in text.lower():
            sign = ord(c) if c.isalpha() else 0
            if sign or line[-1]:
                line.append(sign)
        line.append(0)
        want = np.zeros(langid.SIZE)
        for a, b, c in zip(line, line[1:], line[2:]):
            if a or b or c:
                want += np.roll(langid.letter(a), 2).astype(int) * np.roll(langid.letter(b), 1) * langid.letter(c)
        if not any(line):
            want[:] = 0
        assert (row == want).all(), text


def test_accuracy_on_held_out_rows(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda v: "".join(rnd.choice(v) for _ in range(rnd.randint(1, 7)))
    rows = [(i, " ".join(word(LETTERS[lang]) for _ in range(rnd.randint(5, 80))), lang, "s") for i, lang in ((i, rnd.choice(list(LETTERS))) for i in range(400))]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "12 - 34", None, "s"), (None, "abc abc", None, None), (1003, "ab" * 500_000, "aa", "s"), rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op1_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:400]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert next(r for r in got if r.doc_id == 1003).lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(docs, langid.fit(docs)).collect()] == [("und", 0.0)]
    assert langid.identify(docs.where("false"), langid.fit(docs.where("false"))).count() == 0


def test_many_languages(spark, monkeypatch):
    # Each of 600 languages has letters of its own and is predicted, in one pass or in several.
    texts = [(k, " ".join([chr(0x4E00 + 3 * k + j % 3) * 2 for j in range(12)]), f"l{k:03}") for k in range(600)]
    texts += [(1000 + k, t, lang) for k, t, lang in texts] + [(5000, "", "l001")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs)
    learned = {lang for k, t, lang in texts if t and zlib.crc32(str(k).encode()) % 4 != 2}
    assert set(model[0]) == learned and len(learned) > 500
    want = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, model).collect()}
    assert all(lang == got for k, t, lang in texts if t and lang in learned for d, got, _ in want if d == k)
    monkeypatch.setattr(langid, "BLOCK", 250)
    assert {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, model).collect()} == want
    # Two languages with one prototype: the first name wins.
    same = (["a", "b"], np.stack([model[1][0]] * 2))
    monkeypatch.setattr(langid, "BLOCK", 1)
    assert {r.lang_pred for r in langid.identify(docs.where("doc_id = 0"), same).collect()} == {"a"}
