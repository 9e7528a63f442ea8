"""Packing, archives, mixing, resharding, lines and toxicity on small tables."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.llm import archives as a
from tracklake.llm import lines, mixing, packing, resharding, toxicity
from tracklake.llm.shared import new_path


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


# packing

def test_packing_round_trip(spark):
    rng = random.Random(1)
    texts = [text(rng, rng.choice((0, 1, 5, 40, 400))) for _ in range(60)] + [None, "", "<|endoftext|> as text"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(2)
    rows = packing.packed(docs, length=64).cache()
    encoding = packing._encoding(packing.TOKENIZER)
    pieces = {}
    for r in packing.unpack(rows).collect():
        pieces.setdefault(r.doc_id, {})[r.doc_offset] = np.frombuffer(bytes(r.ids), "<u2")
    for i, t in enumerate(texts):
        ids = np.concatenate([x for _, x in sorted(pieces.get(i, {}).items())]) if i in pieces else np.zeros(0)
        assert ids.tolist() == encoding.encode_ordinary(t or "")
    for r in rows.collect():
        assert len(r.ids) == 128 and r.cu_seqlens[0] == 0 and len(r.doc_ids) == len(r.cu_seqlens) - 1
        places = packing.positions(r.cu_seqlens, 64)
        assert len(places) == 64 and np.flatnonzero(places == 0).tolist() == r.position_resets
    assert packing.packed(docs.limit(0)).count() == 0


def test_best_fit_equals_plain_search():
    rng = random.Random(2)
    sizes = np.array([rng.randint(1, 100) for _ in range(500)])
    rows: list[int] = []
    for size in sorted(sizes.tolist(), reverse=True):
        fits = [r for r in rows if r >= size]
        if fits:
            rows.remove(min(fits))
            rows.append(min(fits) - size)
        else:
            rows.append(100 - size)
    packed = packing.best_fit(sizes, 100)
    assert sorted(100 - sum(sizes[p] for p in x) for x in packed) == sorted(rows)
    assert sorted(p for x in packed for p in x) == list(range(500))


# archives

def test_archives_round_trip(spark):
    big = "é" * 700
    pages = [(1, "http://x/1", big), (5, "http://x/5", big), (3, "http://x/ 3", big), (4, None, None), (6, "http://x/6", "short"), (7, "http://x/7", "short"), (8, "u", "WARC/1.0\r\n\r\n" * 5), (9, "v", "\n\nhttp://x 0.0.0.0 1 text/html 5\n"), (None, "w", big)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, size int").repartition(2)
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    a.write_arcs(df, arcs)
    a.convert(spark, arcs, warcs)
    got = {r.number: r for r in a.warc_records(spark, warcs).collect()}
    assert len(got) == len(pages)
    for number, _, html in pages:
        data, r = (html or "").encode(), got[number]
        assert (r["size"], r.sha1) == (len(data), hashlib.sha1(data).hexdigest())
        again = html == big and number != 5
        assert (r.type, r.refers_to) == (("revisit", 5) if again else ("response", None))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lengths_and_old_urls(version):
    records = [("http://a/with space", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nx"), ("dns:a", b"1.2.3.4\n"), ("e", b"")]
    data = a.arc_header(version, "n.arc") + b"".join(a.arc_record(version, u, c, "n.arc", 0) for u, c in records)
    assert [(f["URL"], c) for f, c, _ in a.parse_arc(data)] == records
    assert [c for _, c, _ in a.parse_arc(data[: data.rfind(b"1.2.3.4") + 3])] == [records[0][1]]
    assert a.opened(gzip.compress(data)) == data
    assert a.warc_date("19990102") == "1999-01-02T00:00:00Z" and a.clean_url("a b\n") == "a%20b%0A"


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    r = a.op4_warc(spark, str(tmp_path)).first()
    assert (r.page_id, r.payload_bytes, r.record_type) == (1, 0, "response")


# mixing

def test_budgets_redistribute_among_siblings_first():
    supply = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 1000}
    assert mixing.budgets(supply, {}, 100, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}
    assert mixing.budgets(supply, {("a",): 3.0}, 400, 1) == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 290}
    assert mixing.budgets(supply, {}, 10**6, 2) == {("a", "x"): 20, ("a", "y"): 200, ("b", "x"): 2000}
    assert mixing.budgets(supply, {("b",): 0.0}, 50, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 0}
    assert mixing.budgets({}, {}, 5, 1) == {}


def test_mix_takes_prefixes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rng = random.Random(3)
    rows = [(i, text(rng, rng.randint(0, 30)), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src2"]), 1) for i in range(200)]
    rows += [(500, "", "en", "src0", 1), (501, None, None, None, 1), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int").repartition(3)
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(docs, levels, {("de",): 5.0}, 0.8, epochs=2, seed=1).collect()
    tokens = lambda t: len((t or "").split())
    supply, used, leaves = Counter(), Counter(), {}
    for r in rows:
        supply[(r[2] or "\0", r[3] or "\0")] += tokens(r[1])
    budget = mixing.budgets(dict(supply), {("de",): 5.0}, int(0.8 * sum(supply.values())), 2)
    for r in got:
        assert r.tokens == tokens(r.row.text) and r.row.tokens == 1
        leaf = (r.lang or "\0", r.source or "\0")
        used[leaf] += r.tokens_used
        leaves.setdefault((leaf, r.epoch), []).append(r)
    assert {k: v for k, v in used.items() if v} == {k: v for k, v in budget.items() if v}
    count = Counter(r[2:4] for r in rows)
    for (leaf, epoch), some in leaves.items():
        assert sum(r.tokens_used < r.tokens for r in some) <= 1
        if (epoch + 1) * supply[leaf] <= budget[leaf]:
            assert len(some) == count[tuple(None if x == "\0" else x for x in leaf)]
    assert mixing.mix(docs.limit(0), levels, {}, 0.5).count() == 0


# resharding

def test_transfers_move_the_fewest_bytes():
    rng = random.Random(4)
    for _ in range(30):
        old = {k: rng.randint(0, 1000) for k in rng.sample(range(20), rng.randint(1, 12))}
        n, total = rng.randint(1, 16), sum(old.values())
        moves = resharding.transfers(old, n)
        part = [total * (j + 1) // n - total * j // n for j in range(n)]
        came, went = Counter(), Counter()
        for i, j, size in moves:
            came[j] += size
            went[i] += size
        assert [came[j] for j in range(n)] == part and all(went[i] == old[i] for i in old)
        stay = sum(min(old[k], part[k]) for k in old if k < n)
        assert sum(s for i, j, s in moves if i != j) == total - stay


def test_reshard(spark, monkeypatch):
    monkeypatch.setattr(resharding, "BUCKET_ROWS", 20)
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randint(0, 40)), f"s{min(5, rng.randrange(12))}", -1) for i in range(400)] + [(None, None, None, 0), (7, "same", "s1", 0), (7, "same", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(3)
    first = new_path(spark, "first")
    got = resharding.reshard(docs, resharding.old_layout(), first, shards=4).collect()
    assert sorted((tuple(r.row) for r in got), key=repr) == sorted(rows, key=repr)
    sizes = Counter()
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    for r in got:
        sizes[r.shard] += len((r.row.text or "").encode()) + 1
    assert max(sizes.values()) - min(sizes.values()) < 500
    # moved again into as many, all files written: every row comes back (test_edges names the folder before)
    where = spark.createDataFrame([(r.row.doc_id, r.shard) for r in got if r.row.doc_id not in (None, 7)], "doc_id long, at int")
    again = resharding.reshard(docs.join(where, "doc_id"), F.col("at"), new_path(spark, "second"), shards=4, old_path=None).collect()
    assert len(again) == 399
    assert resharding.reshard(docs.limit(0), resharding.old_layout(), new_path(spark, "none")).count() == 0


# lines

def brute_lines(docs, size):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        parts = t.split("\n") if t else []
        gone = set()
        for p in range(len(parts) - size + 1):
            key = tuple(parts[p : p + size])
            if key in seen:
                gone.update(range(p, p + size))
            seen.add(key)
        out[i] = (len(parts), len(gone), "\n".join(x for k, x in enumerate(parts) if k not in gone) if gone else t or "")
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    docs = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n"), (103, "\n\n\n"), (104, "z\ny\nx\n"), (105, "q\nz\ny\nx\n\n"), (None, "z\ny\nx")]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, place int").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, bytes(r.kept).decode()) for r in lines.remove_repeated_lines(df).collect()}
    assert got == brute_lines(docs, 3)
    assert lines.remove_repeated_lines(df.limit(0)).count() == 0


# toxicity

def test_toxicity_learns_and_scores(spark, tmp_path):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        t, bad = text(rng, rng.randint(20, 120)).split(), i % 4 == 0
        for _ in range(3 if bad else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["zuxotty", "qwivvle"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(None, None), (900, ""), (901, None), (902, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9
    assert got[900].score == got[901].score < 0.5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxicity_score for r in toxicity.scored(docs, toxicity.train(docs, none)).collect()] == [0.0, 0.0]


def test_toxicity_scores_equal_a_plain_computation(spark):
    """Every window compressed with both dictionaries, one after the other."""
    rng = random.Random(8)
    texts = [text(rng, rng.randint(5, 90)) + (" zuxotty qwivvle scurvex" if i % 4 == 0 else "") for i in range(240)]
    model = toxicity.fit([t.encode() for t in texts], np.array([int(i % 4 == 0) for i in range(240)]))
    rows = [*texts[:40], "", "x", "Zuxotty " * 300, None]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(rows)], "doc_id long, text string, toxicity_score double").repartition(2)
    got = {r.doc_id: r.toxicity_score for r in toxicity.scored(docs, model).collect()}
    pairs = [[toxicity._compressor(d, careful) for d in (model.ordinary, model.toxic)] for careful in (False, True)]
    assert 1 <= model.thresholds[0] < model.thresholds[1] <= toxicity.MOST_GAIN
    for i, t in enumerate(rows):
        data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode()
        count = max(0, -(-(len(data) - toxicity.WINDOW) // toxicity.STRIDE)) + 1 if data else 0
        gains = []
        for k in range(count):
            window = data[k * toxicity.STRIDE : k * toxicity.STRIDE + toxicity.WINDOW]
            quick, careful = (len(a.compress(window)) - len(b.compress(window)) for a, b in pairs)
            if quick >= toxicity.QUICK:
                gains.append(min(max(careful, 0), toxicity.MOST_GAIN))
        gains.sort(reverse=True)
        low, high = (sum(g >= x for g in gains) for x in model.thresholds)
        features = np.array([(gains + [0, 0])[0], (gains + [0, 0])[1], np.log1p(low), np.log1p(high), np.log1p(count)])
        z = (features - model.mean) / model.scale @ model.weight[1:] + model.weight[0]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)


def test_toxicity_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.scored(docs, toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).count() == 0
    again = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert toxicity.scored(again, toxicity.train(again, spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int"))).count() == 3
