import re
from collections import Counter, defaultdict

import pytest

from tracklake.llm import divergence as dv


def plain(rows, least, ranks):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[a-z\u0080-\U0010ffff]+", low)
        groups.add((lang, source))
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        names = sorted(s for x, s in groups if x == lang)

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        whole = Counter()
        for s in names:
            whole.update(counts[lang, s])
        p, q = {s: share(counts[lang, s]) for s in names}, share(whole)
        for s in names:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


ROWS = [
    ("The cat, the dog and the CAT", "en", "a"), ("a cat sat", "en", "b"), ("dog dog dog", "en", "c"), ("the end", "en", "a"), (None, "en", "empty"), ("", "en", "b"), ("123 4!", "en", "digits"),
    ("Äpfel und Öl und Äpfel", "de", "a"), ("und äpfel", "de", None), ("Äpfel und 漢字 und漢", "de", "a"), ("alone", None, None), ("alone", None, "x"), ("only one source", "fr", "z"), ("The cat, the dog and the CAT", "en", "a"),
]


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("least", [1, 2, 100])
def test_equals_plain(spark, least):
    docs = spark.createDataFrame(ROWS, "text string, lang string, source string").repartition(3)
    assert found(dv.divergence(docs, least=least)) == plain(ROWS, least, 50)


def test_many_blocks_of_terms_and_sources(spark, monkeypatch):
    """Tiles of few terms and sources, counters emptied often, texts cut into pieces, pairs in several broadcasts."""
    for name, value in {"BLOCK_TERMS": 3, "BLOCK_GROUPS": 2, "MOST_TERMS": 20, "PIECE": 16, "PAIRS_AT_ONCE": 2}.items():
        monkeypatch.setattr(dv, name, value)
    words = [chr(97 + i % 26) * (1 + i // 26) for i in range(60)]
    rows = [(" ".join(words[(i * j) % (7 + i % 53)] for j in range(40)), f"l{i % 2}", f"s{i % 7 if i % 3 else 0}") for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert found(dv.divergence(docs, least=5, ranks=3)) == plain(rows, 5, 3)


def test_ties_clashing_names_and_very_long_texts(spark):
    rows = [("b a c " * 50_000, "x", "s"), ("c b", "x", "t"), ("a b", "x", "t"), ("a", "x", "u")]
    docs = spark.createDataFrame([(*r, 1, 2, "k", 3) for r in rows], "text string, lang string, source string, rank int, value int, term string, `a.b` int")
    assert found(dv.divergence(docs, least=1)) == plain(rows, 1, 50)


def test_empty(spark):
    assert dv.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact():
    import numpy as np

    big = [(10**14 + 7, 3 * 10**15 + 11, 999), (0, 10**15, 10**6), (12, 12, 1), (5, 17, 3)]
    for count, total, terms in big:
        assert dv.shares(np.array([count]), np.array([total]), terms)[0] == 1 + 10**9 * (count + 5) // (total + 5 * terms)
    with pytest.raises(ValueError):
        dv.shares(np.array([1]), np.array([10**16]), 1)
