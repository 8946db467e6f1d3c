import random
import re

import numpy as np

from lexiloom.llm import common, sentences

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def cut(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = list(WORD.finditer(low))
    starts = [k for k, m in enumerate(words) if not k or any(c in ".!?;:\n\r" for c in low[words[k - 1].end() : m.start()])]
    # In a sentence, the words with the least hash of some PIECE words in a row begin pieces.
    data = np.frombuffer(low.encode(), np.uint8)
    h, size = common.Words(data, np.array([0, len(data)]), common.ALNUM).hash.tolist(), sentences.PIECE
    rows = [range(k, k + size) for a, b in zip(starts, [*starts[1:], len(words)]) for k in range(a, b - size + 1)]
    starts = sorted({*starts, *(k for row in rows for k in row if h[k] == min(h[x] for x in row))})
    return [[m.group() for m in words[a:b]] for a, b in zip(starts, [*starts[1:], len(words)])], [words[a].start() for a in starts]


def brute(docs):
    seen, rows = {}, []
    for i, text in docs:
        s, _ = cut(text)
        own = []
        for a in range(len(s)):
            b = a + sentences.RUN
            while b <= len(s) and sum(map(len, s[a:b])) < sentences.WORDS:
                b += 1
            if b <= len(s):
                key = tuple(w for x in s[a:b] for w in x)
                own.append((key, a, b))
                if i is not None:
                    seen[key] = min(seen.get(key, (i, a)), (i, a))
        rows.append((i, text, s, own))
    out = []
    for i, text, s, own in rows:
        gone = {x for key, a, b in own if i is not None and seen[key] < (i, a) for x in range(a, b)}
        _, at = cut(text)
        kept = text if not gone else text[: at[0]] + "".join(text[p:q] for k, (p, q) in enumerate(zip(at, [*at[1:], len(text)])) if k not in gone)
        out.append((i, len(s), len(gone), kept))
    return sorted(map(str, out))


def corpus():
    rnd = random.Random(4)
    some = lambda: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 9))).capitalize() + rnd.choice([". ", "! ", ".\n", "? é "])
    passages = [[some() for _ in range(rnd.randint(5, 9))] for _ in range(6)]
    docs = [(i, "".join([some() for _ in range(rnd.randint(0, 6))] + rnd.choice(passages)[rnd.randint(0, 2) :] + [some() for _ in range(rnd.randint(0, 6))])) for i in range(60)]
    return docs + [(200, "Only. Short. Ones. "), (201, "Only. Short. Ones. "), (202, None), (203, ""), (None, docs[3][1]), docs[5], (204, docs[6][1] * 2)]


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, h int").repartition(3)
    got = sentences.remove(df).collect()
    assert sorted(str((r.doc_id, r.n_sentences, r.n_removed, r.text)) for r in got) == brute(docs)
    assert sentences.remove(df.where("false")).count() == 0


def test_long_sentences_align(spark):
    rnd = random.Random(9)
    some = lambda n: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(5)) for _ in range(n))
    passage = some(120)
    docs = [(1, some(30) + " " + passage + " " + some(40)), (2, some(70) + " " + passage), (3, some(200))]
    got = {r.doc_id: r for r in sentences.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text == docs[0][1] and got[3].text == docs[2][1]
    assert len(docs[1][1]) - len(got[2].text) > 0.6 * len(passage)


def test_passages_of_few_sentences(spark):
    rnd = random.Random(12)
    some = lambda n: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(5)) for _ in range(n))
    docs, passages = [], []
    for k in range(40):
        size = 51 + k % 3 * 10
        # One sentence that begins and ends in the passage, two of them, or parts of longer ones.
        one, stop = rnd.randint(22, 30), [". ", " "][k % 2]
        passage = some(one) + (". " if k % 4 < 2 else " ") + some(size - one)
        passages.append(passage)
        docs += [(2 * k + j, some(rnd.randint(5, 40)) + stop + passage + stop + some(rnd.randint(5, 40))) for j in (0, 1)]
    got = {r.doc_id: r for r in sentences.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    gone = [set(WORD.findall(docs[2 * k + 1][1])) - set(WORD.findall(got[2 * k + 1].text)) for k in range(40)]
    assert min(map(len, gone)) >= sentences.WORDS and sum(map(len, gone)) >= 0.7 * sum(len(p.split()) for p in passages)
    # The first of them stay, and so does all that stands around the others.
    assert all(got[2 * k].text == docs[2 * k][1] for k in range(40))
    assert all(gone[k] <= set(WORD.findall(passages[k])) for k in range(40))


def test_short_repeats_stay(spark):
    # A line that many texts share is left alone when it has fewer words than a span.
    rnd = random.Random(3)
    some = lambda n: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(5)) for _ in range(n)) + ". "
    line = some(sentences.WORDS - 1)
    docs = [(k, some(20) + some(9) + line + some(30)) for k in range(30)]
    got = sentences.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [(k, t, 0) for k, t in docs]


def test_hot_spans(spark, monkeypatch):
    # The rows of a hot hash are dealt to several tasks, with the same result.
    monkeypatch.setattr(sentences.common, "HOT_ROWS", 5)
    docs = corpus() + [(1000 + k, corpus()[1][1]) for k in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").repartition(3)
    got = sentences.remove(df).collect()
    assert sorted(str((r.doc_id, r.n_sentences, r.n_removed, r.text)) for r in got) == brute(docs)


def test_one_very_long_text(spark):
    rnd = random.Random(21)
    some = lambda n: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(4)) for _ in range(n))
    text = some(200_000)
    docs = [(1, text), (2, some(40) + ". " + text[:500_000].rsplit(" ", 1)[0])]
    got = {r.doc_id: r for r in sentences.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text == text and len(got[2].text) < 800
