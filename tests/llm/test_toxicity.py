import random
import zlib

from lexiloom.llm import toxicity


def test_folding():
    assert toxicity.fold("M0R0N mоrоn 1D10T 2024 $tup1d") == "moron moron idiot 2024 stupid".replace("l", "i")
    assert toxicity.fold("") == ""


def test_matches_need_word_edges():
    lexicon = toxicity.Lexicon({"bad ": 3.0, "awfu": 2.0}, {"bad iuck"})
    assert lexicon.weigh("bad") == 30.0 and lexicon.weigh("badly") == 0 and lexicon.weigh("awfully") == 20.0 and lexicon.weigh("xawful") == 0
    assert lexicon.weigh("bad luck") == 0 and lexicon.weigh("8ad ok") == 30.0 and lexicon.weigh(None) == 0


def test_held_out_rows(spark, tmp_path):
    rnd = random.Random(6)
    clean = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        words = [rnd.choice(clean) for _ in range(rnd.randint(30, 200))]
        for _ in range(max(1, len(words) // 40) if toxic else 0):
            words[rnd.randrange(len(words))] = rnd.choice(["zgrump", "gr0nk", "gronk", "blerqas", "blerqum"])
        docs.append((i, " ".join(words), 1))
        labels.append((i, int(toxic)))
    docs += [(5000, None, 1), (5001, "", 1), (None, "gronk", 1), docs[0], (5002, "gronk " * 50_000, 0)]
    labels += [(None, 1), (5000, None), (5001, 0), labels[1]]
    spark.createDataFrame(docs, "doc_id long, text string, toxic int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert next(r for r in got if r.doc_id == 5002).predicted == 1 and next(r for r in got if r.doc_id == 5001).predicted == 0
    kept = toxicity.reject(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {str(r.doc_id) for r in kept.collect()} == {str(r.doc_id) for r in got if not r.predicted}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.where("false"), toxicity.fit(docs, labels)).count() == 0


def test_few_labels(spark):
    rnd = random.Random(3)
    clean = ["".join(rnd.choice("aeionrst") for _ in range(6)) for _ in range(300)]
    docs = [(i, " ".join([*rnd.choices(clean, k=30), *(["zgrump"] if i % 6 == 0 else [])])) for i in range(36)]
    rows, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in docs], "doc_id long, toxic int")
    assert any("zgrump ".startswith(t) for t in toxicity.fit(rows, labels)[0])
    assert {r.doc_id for r in toxicity.reject(rows, labels).collect()} == {i for i, _ in docs if i % 6}
    # Too few for any term: no text is rejected by one.
    one = labels.where("doc_id = 0 or toxic = 0")
    assert toxicity.fit(rows, one)[:2] == ({}, set()) and toxicity.reject(rows, one).count() == 36


def test_many_terms(spark):
    # More terms and exceptions than a fixed table would hold; all that pass the tests are learned.
    rnd = random.Random(9)
    # Words of four letters have no shorter beginnings.
    bad = sorted({"".join(rnd.choice("bcdfgmnprstvzaeou") for _ in range(4)) for _ in range(7000)})[:6000]
    clean = ["xx" + w for w in rnd.sample(bad, 400)]
    docs = [(i, " ".join(rnd.choices(clean, k=30) + (bad[(i // 2 % 20) * 300 :][:300] if i % 2 else []))) for i in range(400)]
    rows, labels = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    terms = toxicity.fit(rows, labels)[0]
    assert len(terms) > 4000


def test_ties_and_repeats(spark):
    docs = spark.createDataFrame([(1, "zgrump a b"), (1, "zgrump a b"), (2, "zgrump a b"), (3, "a b")], "doc_id long, text string")
    got = toxicity.score(docs, ({"zgrump ": 4.0}, set(), (-3.0, 2.0))).collect()
    assert len({r.score for r in got if r.doc_id != 3}) == 1 and len(got) == 4
    # A score of exactly the cut counts as toxic.
    at = toxicity.score(docs.where("doc_id = 3"), ({"zgrump ": 4.0}, set(), (float(__import__("math").log(0.3 / 0.7)), 0.0))).first()
    assert (at.score, at.predicted) == (0.3, 1)
