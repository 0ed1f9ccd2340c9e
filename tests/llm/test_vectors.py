"""Nearest neighbours against brute force, codes against plain k-means, and both on odd rows."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import queries, vector_codes, vector_forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def product(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=True):  # sum() would carry the rounding errors along
        total += float(a) * float(b)
    return total


def brute_nearest(rows, asked, k):
    """{query id: [(vec_id, score)]} by plain loops over all rows."""
    out = {}
    for q, x in rows.items():
        if asked(q):
            scores = [(-product(x, y), i) for i, y in rows.items() if i != q and len(y) == len(x)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect()):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dim))
    return (x * rng.lognormal(0, 0.8, (n, 1))).astype(np.float32)


# --- nearest neighbours ----------------------------------------------------------------------------------------------


def test_query_equals_brute_force_where_ranges_hold_all_rows(spark, sf):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert listed(queries.op11_nearest_vectors(spark, sf)) == brute_nearest(rows, lambda i: i % 20 == 0, 20)


def test_recall_of_narrow_ranges_over_norms_that_differ(spark):
    x = clustered(6000, 24, 5)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = listed(vector_forest.nearest(df, F.col("vec_id") % 50 == 0, k=10, trees=12, candidates=6000))
    wide = x.astype(np.float64)
    hits = 0
    for q, found in got.items():
        s = wide @ wide[q]
        s[q] = -np.inf
        hits += len({i for i, _ in found} & set(np.argsort(-s)[:10].tolist()))
        assert all(math.isclose(s[i], v, rel_tol=1e-9) for i, v in found) and [v for _, v in found] == sorted((v for _, v in found), reverse=True)
    assert len(got) == 120 and hits >= 0.9 * 1200


def test_one_vector_on_a_third_of_all_rows(spark):
    """Its copies are all nearest to one another; each lists the smallest other ids, and nothing is lost to the group's size."""
    x = clustered(400, 8, 6)
    rows = {i: (x[0] if i % 3 == 0 else x[i]).tolist() for i in range(400)}
    df = spark.createDataFrame([(i, v, 0) for i, v in rows.items()], SCHEMA)
    assert listed(vector_forest.nearest(df, F.col("vec_id") % 20 == 0, k=7)) == brute_nearest(rows, lambda i: i % 20 == 0, 7)


def test_ascent_takes_the_longest_prefix_that_holds_enough(spark):
    rng = np.random.default_rng(7)
    h = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1))
    import pyarrow as pa

    asks = np.arange(0, 3000, 100)
    t = pa.table({"space": np.zeros(3000, np.int32), "tree": np.zeros(3000, np.int32), "block": np.zeros(3000, np.int64), "pos": np.arange(3000), "h": vector_forest._signed(h),
                  "role": np.isin(np.arange(3000), asks).astype(np.int32), "rep": np.arange(3000)})
    t = vector_forest._reach(t.take(pa.array(rng.permutation(3000))))
    asks = asks[asks < vector_forest.BLOCK]
    assert sorted(t.column("rep").to_pylist()) == asks.tolist()
    for row in t.to_pylist():
        reach = np.frombuffer(row["reach"], np.int16).reshape(-1, 2)
        for length in (0, 1, 3, 7, 12, 64):
            same = [i for i in range(3000) if int(h[i]) >> (64 - length) == int(h[row["rep"]]) >> (64 - length)]
            assert reach[length].tolist() == [min(vector_forest.BLOCK, row["rep"] - same[0]), min(vector_forest.BLOCK, same[-1] - row["rep"])]
    one = spark.createDataFrame([(r["rep"], 0, [(0, r["pos"], bytes(r["reach"]))]) for r in t.to_pylist()], "rep long, space int, found array<struct<tree:int,pos:long,reach:binary>>")
    for r in one.mapInArrow(vector_forest._ascend(40, 1), "rep long, space int, tree int, low long, high long").collect():
        longest = max(n for n in range(65) if n == 0 or sum(int(v) >> (64 - n) == int(h[r.rep]) >> (64 - n) for v in h) >= 40)
        same = [i for i in range(3000) if int(h[i]) >> (64 - longest) == int(h[r.rep]) >> (64 - longest)]
        assert (r.low, r.high) == (max(same[0], r.rep - vector_forest.BLOCK), min(same[-1], r.rep + vector_forest.BLOCK))


def odd_vectors(spark, kind="float"):
    rows = [
        (0, [1.0, 0.0, 0.5, 0.0], 1), (1, None, 1), (2, [0.0, 0.0, 0.0, 0.0], None), (3, [1.0, None, 0.0, 0.0], 1), (4, [float("nan"), 1.0, 0.0, 0.0], 1),
        (5, [float("inf"), 1.0, 0.0, 0.0], 2), (6, [], 2), (7, [1.0, 2.0, 3.0], 2), (8, [1.0, 0.0, 0.5, 0.0], None), (8, [1.0, 0.0, 0.5, 0.0], None), (9, [0.5, 0.0, 0.5, 0.0], 3),
        (9, [-0.5, 0.0, 0.5, 0.0], 3), (None, [1.0, 1.0, 1.0, 1.0], 1), (20, [-1.0, 0.0, -0.5, 0.0], 1), (40, [1e30, 1.0, 0.0, 1e-30], 1), (60, [0.0, 0.0, 0.0, 3.0], 4),
    ]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumns({c: F.lit("own") for c in ("rep", "code", "codes", "error", "h", "pos", "space", "part", "Rank", "score")})


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_on_odd_rows(spark, kind):
    df = odd_vectors(spark, kind)
    one = {}
    for r in df.collect():
        x = r.embedding
        if r.vec_id is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            one[r.vec_id] = min(x, one.get(r.vec_id, x))
    got = listed(vector_forest.nearest(df, F.col("vec_id") % 20 == 0, k=3))
    assert got == brute_nearest(one, lambda i: i % 20 == 0, 3) and set(got) == {0, 20, 40, 60}
    assert listed(vector_forest.nearest(df, F.col("vec_id") == 7, k=3)) == {}
    assert vector_forest.nearest(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []


# --- codes -----------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    """({row number: (codes, error)}, books) by plain loops over whole numbers; rows are (vec_id, vector) in their order."""
    cut = []
    for _, x in rows:
        v = [math.floor(1024 * int(c)) if abs(c) > 2**53 else math.floor(1024 * c) for c in x]
        v += [0] * (-len(v) % parts)
        width = len(v) // parts
        cut.append([v[p * width : (p + 1) * width] for p in range(parts)])
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in cut:
                own.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else old for e, old in enumerate(books[p])]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    return [([e for _, e in f], sum(d for d, _ in f)) for f in found], books


def coded_rows(df, **how):
    coded, books = vector_codes.compress(df, **how)
    rows = vector_codes.with_label_error(coded).collect()
    return [(r.vec_id, list(np.frombuffer(r.codes, np.uint16)), r.error, r.label, r.label_error) for r in rows], books


@pytest.mark.parametrize("scale", [1.0, 2e5])
def test_codes_equal_plain_k_means(spark, scale):
    """Small numbers are compared as float64, large ones as Python integers; coarse ones make many ties and equal entries."""
    rng = random.Random(8)
    rows = [(i, [scale * rng.choice([-0.5, -0.25, 0.0, 0.001, 0.25, 1.0]) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame([(i, x, i % 3 if i % 4 else None) for i, x in rows], "vec_id long, embedding array<double>, label int").repartition(5)
    got, books = coded_rows(df, parts=3, entries=20, rounds=3)
    want, want_books = plain_codes(rows, 3, 20, 3)
    assert books == want_books and {i: (c, e) for i, c, e, *_ in got} == {i: w for (i, _), w in zip(rows, want, strict=True)}
    for label in (None, 0, 1, 2):
        assert {x[4] for x in got if x[3] == label} == {sum(x[2] for x in got if x[3] == label)}


def test_exponion_from_any_start_and_sums_in_limbs():
    rng = np.random.default_rng(9)
    x, book = rng.integers(-30, 30, (500, 3)), rng.integers(-30, 30, (40, 3))
    book[7] = book[3]
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    for before in (np.zeros(500, np.int64), rng.integers(0, 40, 500), np.full(500, 7)):
        found, apart = vector_codes.exponion(x, book, before)
        assert (found == d.argmin(1)).all() and (apart == d.min(1)).all()
    for v in (0, -1, 2**62 - 1, -(2**62), 2**62, -(2**200) + 12345, 2**300 + 1):
        assert sum(k << 32 * i for i, k in enumerate(vector_codes._limbs(v))) == v and all(-(2**63) <= k < 2**63 for k in vector_codes._limbs(v))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_codes_on_odd_rows(spark, kind):
    df = odd_vectors(spark, kind)
    got, _ = coded_rows(df)
    fine = [r for r in df.collect() if r.embedding and len(r.embedding) == 4 and all(v is not None and math.isfinite(v) for v in r.embedding)]
    order = sorted(fine, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.embedding))
    want, _ = plain_codes([(r.vec_id, r.embedding) for r in order], 4, 256, 4)
    text = lambda rows: sorted(map(str, rows))
    assert text((i, list(map(int, c)), e) for i, c, e, *_ in got) == text((r.vec_id, c, e) for r, (c, e) in zip(order, want, strict=True))
    assert coded_rows(df.where("false")) == ([], [])


def test_codes_whose_errors_exceed_a_long(spark):
    df = spark.createDataFrame([(0, [1e20, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    got, books = coded_rows(df, parts=2, entries=1, rounds=0)
    assert books[0] == [[1024 * 10**20]] and [(x[2], x[4]) for x in sorted(got)] == [(0, None), (None, None), (None, None)]


@pytest.mark.parametrize("name", ["op12_vector_codes"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    rows = df.select(columns).collect()
    assert sorted(str(tuple(r)) for r in rows) == sorted(map(str, found.fetchall()))
    books = vector_codes.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))[1]
    assert {r.codebooks_sha256 for r in rows} == {hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()}
