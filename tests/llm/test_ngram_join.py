import random
import re

from lexiloom.llm import ngram_join

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    own = [(i, sets(t)) for i, t in docs]
    near = {i: i for i, _ in docs if i is not None}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                near[y] = x
    return sorted(str((i, len(s), None if i is None else root(i))) for i, s in own)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    some = lambda k: [rnd.choice("abcdefghij") + rnd.choice("xyz") for _ in range(k)]
    base, passage, docs = [some(rnd.choice([2, 4, 5, 6, 30, 60, 120])) for _ in range(12)], some(25), []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(["NEW", "new", "q"])
        if rnd.random() < 0.3:
            w = passage + some(rnd.randrange(1, 6))
        docs.append((i * 3 + 1, rnd.choice([" ", "\n", "  "]).join(w)))
    return docs + [(5000, None), (5001, ""), (5002, " \t"), (None, docs[0][1]), (None, None), docs[7], (5003, "one two"), (5004, "ONE  two"), (5005, "w " * 30000)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_BITS", 16)
    monkeypatch.setattr(ngram_join, "MAP_BITS", 16)
    for seed, group, stars, rounds, sparse in ((1, 2000, 3, 2, 4), (2, 3, 1, 0, 0)):
        monkeypatch.setattr(ngram_join, "GROUP", group)
        monkeypatch.setattr(ngram_join, "STARS", stars)
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        monkeypatch.setattr(ngram_join, "SPARSE", sparse)
        monkeypatch.setattr(ngram_join, "BLOCK", 1024 if sparse else 7)
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, h string").repartition(3)
        got = ngram_join.join_components(df).collect()
        assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs)


def test_empty(spark):
    assert ngram_join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_full_count_table(spark, monkeypatch):
    # With far more shingles than cells, only hot shingles are salted, and the components stay the same.
    monkeypatch.setattr(ngram_join, "CELL_BITS", 7)
    monkeypatch.setattr(ngram_join, "BLOCK_BITS", 4)
    monkeypatch.setattr(ngram_join, "GROUP", 100)
    rnd = random.Random(4)
    some = lambda k: [f"w{rnd.randrange(10_000)}" for _ in range(k)]
    hot = some(20)
    docs = [(k, " ".join(hot + some(3) if k % 2 else some(80))) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    counts = ngram_join._counts(df)
    assert counts.sum() == sum(len(sets(t)) for _, t in docs) and counts.min() > ngram_join.GROUP
    rows = ngram_join.prefixes(df, counts)
    of_plain = df.where("doc_id % 2 = 0").select("doc_id").collect()
    salted = ngram_join.prefixes(df.where("doc_id % 2 = 0"), counts).where("place & 511 > 0").count()
    assert salted < 0.25 * rows.count() and len(of_plain) == 300
    got = ngram_join.join_components(df).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs)


def test_blocks_meet_across_parts_only(spark, monkeypatch):
    # Of a shingle with one large part, rows are copied for the few others only, and every pair across parts meets once.
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    parts = [0] * 95 + [1] * 25 + list(range(2, 14))
    rows = spark.createDataFrame([(7, k, 0, p, len(parts)) for k, p in enumerate(parts)] + [(8, 500 + k, 0, k, 3) for k in range(3)], "h long, c long, place long, part long, size long")
    met, copies = {}, 0
    for g in ngram_join._groups(rows).collect():
        copies += len(g["all"])
        left, right = ([r for r in g["all"] if r.block == b] for b in (g.i, g.j))
        for a in left:
            for b in right:
                if a.part != b.part and (g.i != g.j or a.c < b.c):
                    key = tuple(sorted((a.c, b.c)))
                    met[key] = met.get(key, 0) + 1
    every = [(k, p) for k, p in enumerate(parts)]
    want = {(a, b) for a, p in every for b, q in every if a < b and p != q} | {(500, 501), (500, 502), (501, 502)}
    assert met.keys() == want and set(met.values()) == {1}
    assert copies < 0.75 * len(parts) * 16


def test_hot_classes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.common, "HOT_ROWS", 4)
    docs = corpus(3) + [(9000 + k, corpus(3)[1][1]) for k in range(60)]
    got = ngram_join.join_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs)
