import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from lexiloom.llm import bpe, toxicity
from tests.llm import test_decontam, test_ngram_join, test_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(20))) for k in range(5)]
    docs, labels = [], []
    for i in range(400):
        words, toxic = some(rnd.randint(20, 120)), i % 8 == 0
        for _ in range(max(2, len(words) // 20) if toxic else 0):
            words[rnd.randrange(len(words))] = rnd.choice(["zgrump", "vrakk"])
        text = " ".join(words)
        pick = rnd.random()
        if not toxic and pick < 0.2 and i > 8:
            text = docs[rnd.choice([k for k in range(i) if k % 8])][1] + " extra"
        elif not toxic and pick < 0.3:
            text += " " + rnd.choice(items)[1].upper() + " " + " ".join(some(4))
        elif not toxic and pick < 0.4:
            text += " password=hunter2222 " + "0123abcd" * 4
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(toxic)))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, items[0][1], "en", "s", 5), docs[1], (None, docs[2][1], "en", "s", 3), (903, "w " * 20000, "en", "s", 40000)]
    return docs, labels, items


def test_whole_run(spark, tmp_path):
    docs, labels, items = corpus()
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        rows = [(a, None, b) for a, b in rows] if name == "labels" else rows
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, want, str(tmp_path))
        assert out.dtypes == given.dtypes, name
        before = [tuple(r) for r in want.collect()]
        out = spark.createDataFrame(out.collect(), SCHEMA)
        got = sorted(map(str, (tuple(r) for r in out.collect())))
        assert got == sorted(map(str, expected(name, spark, before, labels, items))), name
        want = out
    theirs = Tokenizer.from_file(bpe.path())
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(final) == want.count()
    for r in want.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(final[r.doc_id].ids) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert final[r.doc_id].decoded == theirs.decode(ids, skip_special_tokens=False)
    assert corpus_pipeline.STAGES[0][1](spark, given.where("false"), str(tmp_path)).count() == 0


def expected(name, spark, rows, labels, items):
    if name == "toxicity":
        truth = dict(labels)
        return [r for r in rows if not truth.get(r[0])]
    if name == "ngram_join":
        kept = [eval(x) for x in test_ngram_join.brute([(r[0], r[1]) for r in rows])]
        first = {i for i, _, c in kept if i == c}
        return list(dict.fromkeys(r for r in rows if r[0] is None or r[0] in first))
    if name == "decontamination":
        out = []
        windows = {tuple(w[j : j + 13]) for _, t in items for w in [test_decontam.words(t)] for j in range(len(w) - 12)}
        for r in rows:
            own = list(test_decontam.WORD.finditer("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")))
            hit = {x for j in range(len(own) - 12) if tuple(m.group() for m in own[j : j + 13]) in windows for x in range(j, j + 13)}
            if not hit:
                out.append(r)
            elif len(hit) < len(own):
                text, at = "", 0
                for k, m in enumerate(own):
                    if k in hit:
                        text += r[1][at : m.start()] if k - 1 not in hit else ""
                        at = m.end()
                text += r[1][at:]
                out.append((r[0], text, r[2], r[3], len(text)))
        return out
    out = []
    for r in rows:
        text, past = "", 0
        for a, _, b in test_secrets.brute(r[1]):
            if a >= past:
                text += r[1][past:a] + "[SECRET]"
            past = max(past, b)
        out.append((r[0], text + r[1][past:], r[2], r[3], len(text + r[1][past:])) if past else r)
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "secrets", "bpe"]
    assert re.fullmatch("[0-9.]+", str(toxicity.CUT))
