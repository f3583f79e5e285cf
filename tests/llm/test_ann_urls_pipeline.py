"""Graph search, URL rules and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tideblock.llm import ann, packing, quality, simhash, url_filter
from tideblock.llm.registry import op5_ann_graph


def brute_neighbours(rows, queries, k):
    rows = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in rows:
        if i in queries:
            scored = sorted(((-float(v @ q), j) for j, v in rows if j != i and len(v) == len(q)))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def test_recall_and_scores(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = {}
    for r in op5_ann_graph(spark, small).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute_neighbours(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert set(got) == set(want) and all(sorted(x) == list(range(1, 21)) for x in got.values())
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        ordered = [found[i] for i in range(1, 21)]
        assert ordered == sorted(ordered, key=lambda x: (-x[1], x[0]))
        assert all(abs(vectors[q] @ vectors[j] - s) < 1e-12 for j, s in ordered)
    assert np.mean([len({j for j, _ in found.values()} & {j for j, _ in want[q]}) / 20 for q, found in got.items()]) >= 0.95


def test_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * rng.uniform(0.1, 9)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]  # copies: ties go to smaller ids
    rows += [(500, None), (520, [0.0] * 4), (540, [1.0, None, 0.0, 0.0]), (560, [float("nan")] * 4), (580, [float("inf"), 0.0, 0.0, 0.0]), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (620, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "SHARD_ROWS", 90)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 8)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_neighbours(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert set(got) == set(want)
    assert got[600] == [(601, 4.0)]
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / max(1, len(want[q])) for q in want]) >= 0.95
    assert [j for j, _ in got[400]][:20] == [j for j, _ in want[400]][:20]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id IN (0, 1)"), df.filter("vec_id = 0")).count() == 1


def test_recall_over_several_shards_without_clusters(spark, monkeypatch):
    """Gaussian vectors have no clusters: a fixed beam of 128 misses many of them."""
    vectors = np.random.default_rng(5).normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "SHARD_ROWS", 1500)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = vectors.astype(float) @ vectors.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    assert np.mean([len(got[q] & set(np.argsort(-exact[q])[:20].tolist())) / 20 for q in range(0, 4000, 20)]) >= 0.9


def test_graph_reaches_every_point():
    rng = np.random.default_rng(2)
    points = np.concatenate((rng.normal(size=(200, 6)), 50 + rng.normal(size=(200, 6)) * 0.5)).astype(np.float32)
    graph, entry = ann.build(points, degree=6)
    assert ann.reached(graph, entry).all()
    found, _ = ann.beam_search(points, (points**2).sum(axis=1), graph, entry, points, 40)
    assert (found[:, 0] == np.arange(400)).mean() > 0.95


URLS = [
    None, "", "no scheme", "http://", "https://a.com", "https://a.com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://example.com/en/", "http://example.com/EN/", "http://notexample.com/en/",
    "http://x.y.example.com/en/1", "http://www.example.com/en/", "http://a.www.example.com/en/q", "http://b.net/es/", "http://net/fr/x", "http://b.net/fr", "http://b.net?x/es/", "http://c.org/a://b.com/", "x://h.com#/frag",
    "http://spam-farm.org/a", "http://cheap-pills.net/es/", "http://cheap-pills.net/", "http://é.com/ß", "http://[::1]:80/x", "http://a.com:80/", "http://u@com/p", "http://com/", "http:///en/", "http://doubleclick.example/x\ny",
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(a, h, p) for a, h, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[1] + x[2]), default=None)


def test_url_rules(spark):
    rng = random.Random(3)
    urls = URLS + [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'x.'])}{rng.choice(['example.com', 'a.net', 'net', 'b.org', 'Example.Com'])}{rng.choice(['', '/', '/en/', '/es/', '/fr/q', '/enx'])}{rng.choice(['', '?a=/en/', '#x'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)] + [(5, URLS[4], "own"), (None, URLS[8], None)], "page_id long, url string, host string")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = URLS[8] if r.page_id is None else None
        host, path, rule = brute_rule(url or urls[r.page_id]) if r.page_id != 5 else (r.host, r.path, ("allow", "com", "/") if r.path == "/" else None)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1] + rule[2]), (r, rule)
        if rule:
            assert r.verdict == rule[0]
        else:
            assert r.verdict == ("block" if r.pattern else "allow")
    blocked = {urls[r.page_id] for r in got if r.page_id is not None and r.pattern}
    assert blocked & set(URLS) == {"http://spam-farm.org/a", "http://cheap-pills.net/", "http://doubleclick.example/x\ny"}
    assert max(r.n_tried for r in got) <= 5
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_pipeline_stages(spark, small):
    """Each stage against brute force over what the one before kept."""
    from test_text_operators import brute_contamination, brute_fingerprint, brute_lines, ids_of, words

    import corpus_pipeline as p
    from tideblock.llm.common import written

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = [docs]
    for _, f in p.STAGES[:-1]:
        steps.append(written(f(spark, steps[-1], small), "test"))
        assert steps[-1].schema.names == docs.schema.names and [f.dataType for f in steps[-1].schema] == [f.dataType for f in docs.schema]
    rows = [sorted(tuple(r) for r in x.collect()) for x in steps]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.unpack(quality.train(docs, labels, F.coalesce(quality.remainder("doc_id") != 2, F.lit(True))))
    scores = quality.score(model, [quality.features(r[1].encode()) for r in rows[0]])
    assert rows[1] == [r for r, s in zip(rows[0], scores, strict=True) if s >= 0.7]
    lines = brute_lines(rows[1])
    assert rows[2] == [(r[0], t, r[2], r[3], len(t) if gone else r[4]) for r, (t, n, gone) in zip(rows[1], lines, strict=True) if not n or gone < n]
    fps, sets = [brute_fingerprint(r[1]) for r in rows[2]], [simhash.shingles(r[1].encode()) for r in rows[2]]
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert rows[3] == [r for i, r in enumerate(rows[2]) if root[i] == i]
    bench = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    judged = [brute_contamination(r[1], bench) for r in rows[3]]
    assert rows[4] == [r for r, (_, n_hit, n_items, *_) in zip(rows[3], judged, strict=True) if n_items < 2 and n_hit < 8] and len(rows[4]) < len(rows[3])
    got = p.run(spark, small).collect()
    want = Counter()
    for r in rows[4]:
        n = len(ids_of(public_tokenizers.path("word_bpe_49k.json"), r[1])) + 1
        for k, s in enumerate(range(0, n, 4096)):
            want[r[0], k, s, min(4096, n - s)] += 1
    assert Counter(tuple(r)[:4] for r in got) == want
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 4096) + 1


def test_pipeline_with_odd_rows(spark, small, odd, empty):
    import corpus_pipeline as p

    for docs in (odd, empty):
        for _, f in p.STAGES:
            docs = f(spark, docs, small)
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        docs.collect()
    kept = p.drop_near_copies(spark, odd, small).collect()
    assert sum(r.doc_id is None for r in kept) == 2
    named = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(named) == len(set(named))
    assert packing.pack_documents(p.drop_near_copies(spark, empty, small), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark, small):
    import corpus_pipeline as p

    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(7, text("a")), (7, text("b")), (8, text("b")), (9, text("c")), (9, text("c")), (None, text("d")), (None, text("d")), (5, text("d")), (None, text("e"))]
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in p.drop_near_copies(spark, df, small).collect())
    assert got == Counter([(7, text("a")), (7, text("b")), (9, text("c")), (None, text("d")), (None, text("e"))])


def test_short_items_alone_condemn_no_document(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, "one common phrase here"), (2, "one common phrase and two words more"), (3, "a b c d e f g h i j"), (4, "nothing")]
    spark.createDataFrame([(1, "common phrase"), (2, "two words"), (3, "x a b c d e f g h")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [1, 4]


@pytest.mark.parametrize("name", ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "pipeline"])
def test_registered(name):
    import __spark_entry__ as entry

    assert sum(k.startswith(name) for k in entry.queries()) == 1
