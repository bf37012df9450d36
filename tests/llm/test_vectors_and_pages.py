"""Vector operators against brute force; archives read back as they were written."""

import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.llm import ann, pq_dedup, warc

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, node string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], y, "c", "n") for i, x, y in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[100] + r.normal(size=(40, 16)) * 0.05
    x[200:260] = x[200]
    out = [(i, v.tolist(), int(i % 3 if i < 100 or i >= 260 else 1)) for i, v in enumerate(x)]
    return out + [(1000, None, 1), (1100, [0.0] * 16, 1), (1200, [float("nan")] + [1.0] * 15, 1), (1300, [None] + [1.0] * 15, 1), (1400, x[100].tolist(), None), (1500, [1.0, 2.0], 1)]


def valid(rows):
    return [(i, np.array(x, float), y) for i, x, y in rows if x is not None and len(x) == 16 and None not in x and np.isfinite(np.array(x, float)).all() and any(x)]


def test_multi_index(spark, rows):
    v = table(spark, rows)
    got = ann.search(v, v.where("vec_id % 100 = 0"), recall=0.99).toPandas()
    good = valid(rows)
    ids, x = np.array([i for i, *_ in good]), np.array([a for _, a, _ in good])
    hit = total = 0
    for q, g in got.groupby("query_id"):
        k = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        d[k] = np.inf
        best = np.lexsort((ids, d))[:10]
        hit, total = hit + len(set(ids[best]) & set(g.vec_id)), total + 10
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, len(g) + 1))
        assert np.allclose(g.set_index("vec_id").score, [d[ids == i][0] for i in g.vec_id], atol=1e-12)
    assert hit / total >= 0.9 and set(got.query_id) == {i for i, *_ in good if i % 100 == 0}


def test_walk_is_sorted_and_complete():
    r = np.random.default_rng(2)
    a, b = r.random(7), r.random(5)
    order = ann.walk(a, b, np.ones(35, int), 35)
    assert sorted(order) == list(range(35)) and np.all(np.diff([a[c // 5] + b[c % 5] for c in order]) >= 0)


@pytest.mark.parametrize("block", [2048, 16])
def test_product_quantisation_loses_no_link(spark, rows, block):
    got = {r.vec_id: r for r in pq_dedup.near_duplicate_vectors(table(spark, rows), block=block).collect()}
    assert len(got) == len(rows)
    good = [(i, x, y) for i, x, y in valid(rows) if y is not None]
    x = np.array([a for _, a, _ in good])
    u = x / np.sqrt((x * x).sum(1))[:, None]
    link = (u @ u.T >= 0.93) & (np.array([y for *_, y in good])[:, None] == np.array([y for *_, y in good]))
    np.fill_diagonal(link, False)
    of = np.arange(len(good))
    while True:
        new = np.minimum(of, np.where(link, of[None, :], len(good)).min(1))
        if (new == of).all():
            break
        of = new
    for k, (i, *_) in enumerate(good):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[k].sum(), good[of[k]][0], good[of[k]][0] == i)
    for i in set(got) - {i for i, *_ in good}:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_empty_vectors(spark, rows):
    e = table(spark, rows).limit(0)
    assert ann.search(e, e).count() == 0 and pq_dedup.near_duplicate_vectors(e).count() == 0


def test_pages_come_back(spark):
    big, other = "ü" * 600, "z" * 1000
    rows = [(1, "http://a/ b", big, 9), (2, None, big, 9), (5, "u", big, 9), (3, "u", "small", 9), (4, "u", "small", 9), (6, "u", None, 9), (7, "u", other, 9), (None, "u", other, 9)]
    got = {r.page_id: r for r in warc.pages_by_warc(spark, spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect()}
    assert len(got) == 8 and all(r.verified for r in got.values())
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {1, 2, None}
    assert got[1].refers_to == 5 and got[2].payload_bytes == 1200 and got[None].refers_to == 7 and got[6].payload_bytes == 0
    assert warc.pages_by_warc(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_reader_checks_frames_and_digests():
    data = warc.record("response", "urn:page:1", "http://x", b"hello", None, "2024-01-01T00:00:00Z", 6)
    two = io.BytesIO(data * 2)
    assert [r["payload"] for r in warc.read_stream(two, 7)] == [b"hello"] * 2
    plain = gzip.decompress(data)
    assert not next(warc.read_stream(io.BytesIO(gzip.compress(plain.replace(b"hello", b"jello")))))["verified"]
    for broken in (data[:-9], gzip.compress(plain[:-2]), gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.read_stream(io.BytesIO(broken)))


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("html"))
    archives = warc.write_warc(pages, f"file://{tmp_path}", rotate=2000)
    assert archives.count() >= 16
    back = warc.read_warc(archives)
    assert back.rdd.getNumPartitions() >= 16 and back.where("verified").count() == 400


def test_search_in_blocks_of_queries(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 6)).tolist()
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, ann.search(d, d.where("vec_id % 3 = 0"), recall=1.0).collect()))
    assert want == sorted(map(tuple, ann.search(d, d.where("vec_id % 3 = 0"), recall=1.0, queries_per_turn=7).collect())) and len(want) == 1000


def test_links_of_grouped_vectors_against_brute_force(spark):
    """Vectors around some centres, many of them linked; copies; labels apart."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(12, 16))
    x = np.repeat(centres, 25, axis=0) + r.normal(size=(300, 16)) * r.uniform(0.02, 0.4, (300, 1))
    x[10:14] = x[10]
    label = np.arange(300) % 2
    d = spark.createDataFrame([(i, v, int(y)) for i, (v, y) in enumerate(zip(x.tolist(), label))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.93) & (label[:, None] == label)
    got = {g.vec_id: g for g in pq_dedup.near_duplicate_vectors(d).collect()}
    reach = np.eye(300, dtype=bool) | links
    for _ in range(9):
        reach = reach @ reach
    assert links.sum() > 2000
    assert all((got[i].n_links, got[i].component_id) == (links[i].sum() - 1, reach[i].argmax()) for i in range(300))


def test_tiny_and_huge_vectors_lose_no_link(spark):
    """One valid vector of 1e-200 or 1e200, or of the smallest numbers there are, changes nothing for the others."""
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 8))
    rows = [(2 * i, b.tolist(), 1) for i, b in enumerate(base)] + [(2 * i + 1, (b + 0.01 * r.normal(size=8)).tolist(), 1) for i, b in enumerate(base)]
    rows += [(900, (base[0] * 1e-200).tolist(), 1), (901, (base[1] * 1e200).tolist(), 1), (902, (base[2] * 1e-310).tolist(), 1), (903, [1e-200] + [0.0] * 7, 2), (904, [5e-324] + [0.0] * 7, 2), (905, [1.7e308] + [0.0] * 7, 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {g.vec_id: g for g in pq_dedup.near_duplicate_vectors(d).collect()}
    for i in range(60):
        links = 2 if i < 3 else 1
        assert (got[2 * i].n_links, got[2 * i + 1].n_links, got[2 * i + 1].component_id) == (links, links, 2 * i)
    assert [got[i].component_id for i in (900, 901, 902)] == [0, 2, 4] and [got[i].n_links for i in (903, 904, 905)] == [2, 2, 2] and got[905].component_id == 903
