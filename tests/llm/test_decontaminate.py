import random
import re

from tracklake.llm import decontaminate as d

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(texts, items, window):
    """(words, words hit, items) of each text, by trying every window everywhere."""
    out = []
    for text in texts:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            x = words(item)
            n = min(window, len(x))
            for i in range(len(x) - n + 1 if n and name is not None else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[i : i + n]:
                        hit.update(range(p, p + n))
                        names.add(str(name))
        out.append((len(w), len(hit), sorted(names)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "dé", "e1", "f-g"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 25))) for i in range(12)] + [(3, "solo"), (90, None), (None, "b a b a"), (7, "")]
    texts = [text(rng.randint(0, 80)) for _ in range(40)] + ["", None, "Solo, solo!", items[0][1].upper() + " tail"]
    return texts, items


def check(spark, texts, items, **more):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.row.doc_id: (r.n_words, r.n_hit, r["items"]) for r in d.contamination(docs, bench, **more).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, items, more.get("window", d.WINDOW))


def test_equals_brute_force(spark):
    check(spark, *corpus(1))


def test_short_windows(spark):
    check(spark, *corpus(2), window=4)


def test_blocks_of_items(spark, monkeypatch):
    """A benchmark beyond the bound is taken in blocks, with the same result."""
    monkeypatch.setattr(d, "BLOCK_BYTES", 100)
    check(spark, *corpus(3), window=5)


def test_empty_tables(spark):
    check(spark, ["a b"], [])
    check(spark, [], [(1, "a b")])
