import hashlib
import random
import re

import numpy as np

from lexiloom.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        own, hit, ids = words(text), set(), set()
        for k, t in items:
            w = words(t)
            if k is None or not w:
                continue
            n = min(len(w), 13)
            for a in {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}:
                for x in range(len(own) - n + 1):
                    if tuple(own[x : x + n]) == a:
                        hit.update(range(x, x + n))
                        ids.add(str(k))
        out.append((i, len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return out


def corpus():
    rnd = random.Random(3)
    some = lambda n, v: " ".join(rnd.choice(v) for _ in range(n))
    v = ["The", "of", "é1", "x", "Yz"]
    items = [(k, some(rnd.choice([0, 1, 5, 12, 13, 14, 30]), v + ["q%d" % k])) for k in range(30)] + [(3, some(20, v)), (None, "x"), (99, None), (100, "")]
    docs = [(i, some(rnd.randint(0, 40), v + ["other"]) + "! " + (rnd.choice(items)[1] or "").upper() + "." + some(rnd.randint(0, 300), [*v, "zz"])) for i in range(60)]
    return docs + [(7, docs[7][1]), (None, docs[8][1]), (500, None), (501, ""), (502, "w " * 30000 + items[5][1])], items


def test_index():
    rnd = np.random.default_rng(1)
    text = np.append(rnd.integers(0, 4, 3000), 0)
    index = decontam.FMIndex(text)
    rows = rnd.integers(1, 5, (50, 4))
    low, high = index.search(rows)
    for row, a, b in zip(rows, low, high):
        want = [i for i in range(len(text) - 3) if (text[i : i + 4] == row).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_queries(spark, tmp_path, monkeypatch):
    docs, items = corpus()
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    key = lambda rows: sorted(map(str, rows))
    want = key(tuple(x) for x in brute(docs, items))
    assert key(tuple(r) for r in decontam.op6_decontamination(spark, str(tmp_path)).collect()) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert key(tuple(r) for r in decontam.op6_decontamination(spark, str(tmp_path)).collect()) == want


def test_removal(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Before, {item}; after", None, 5), (2, item, "a", 1), (3, "clean", "b", 5), (4, None, "c", None)], "doc_id long, text string, items2 string, n_chars long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.items2, r.n_chars) for r in decontam.remove(docs, bench).collect()}
    assert got == {1: ("Before, ; after", None, 15), 3: ("clean", "b", 5), 4: (None, "c", None)}
    assert decontam.remove(docs, bench.where("false")).count() == 4


def test_clashing_columns_stay(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"Before, {item}; after", "mine", 7, "x", "y"), (2, "clean", None, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_words int, hit_words string, Items_ string")
    bench = spark.createDataFrame([(k, f"{item} {k}") for k in range(3)], "item_id long, text string")
    got = {tuple(r) for r in decontam.remove(docs, bench).collect()}
    assert got == {(1, "Before, ; after", "mine", 7, "x", "y"), rows[1]}


def test_memory_of_phrases():
    import tracemalloc

    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(30_000)]
    items, size = [], 0
    while size < 8 << 20:
        items.append((str(len(items)), " ".join(rnd.choices(vocabulary, k=300))))
        size += len(items[-1][1])
    tracemalloc.start()
    made = decontam.Phrases(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.groups[0][1].shape == (len(items) * 288, 13)
    assert peak < 400 << 20, peak >> 20
