import re
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.operators import balls, knn
from folioforge.operators.embedding import (
    EmbeddingCache,
    HashingEncoder,
    embed_chunks,
    embedding_model,
    encode_column,
)
from folioforge.operators.index import Retriever, VectorIndex
from folioforge.operators.ranks import stored_in_order, with_numbers
from folioforge.session import new_table_path
from folioforge.sources import tables

VEC = "row long, vec array<float>"


def brute(index, queries, k):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    s = (unit(queries)[:, None, :] * unit(index)[None, :, :]).sum(axis=2)
    return [
        [(int(r), float(s[q][r])) for r in np.lexsort((np.arange(len(index)), -s[q]))[:k]]
        for q in range(len(queries))
    ]


def table(spark, m, name="row"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, f"{name} long, vec array<float>")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(400, 16)).astype("float32")
    m[10] = m[3]        # a tie
    m[20] = 0           # a zero vector
    return m.astype("float64")


@pytest.mark.parametrize("broadcast", [1 << 26, 16 * 8 * 10])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_both_paths_exact(spark, vectors, monkeypatch, broadcast, k):
    monkeypatch.setattr(knn, "_TILE", 1000)
    queries = vectors[:30]
    hits = knn.top_k(
        table(spark, vectors).repartition(5), table(spark, queries, "query_id"), k,
        broadcast_bytes=broadcast,
    )
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.row, r.score))
    for q, want in enumerate(brute(vectors, queries, k)):
        assert [r for r, _ in got[q]] == [r for r, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-12)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_vectors_that_are_not_finite(spark, vectors, bad):
    """One such vector used to hide all others of its batch; now it is an error with its row."""
    broken = vectors.copy()
    broken[7, 3] = bad
    good, some = table(spark, vectors, "query_id"), table(spark, broken)
    with pytest.raises(Exception, match="Vector of row 7 is not finite"):
        knn.top_k(some, good, 3).collect()
    with pytest.raises(ValueError, match="Vector of query 7 is not finite"):
        knn.top_k(table(spark, vectors), table(spark, broken, "query_id"), 3).collect()
    with pytest.raises(Exception, match="is not finite"):
        VectorIndex(16).build(some.withColumnRenamed("row", "id"), ["id"], vector="vec").table.collect()


def test_raw_inner_product(spark):
    m = np.array([[1.0, 0], [3, 0], [0, 2]])
    hits = knn.top_k(
        table(spark, m), table(spark, np.array([[2.0, 1]]), "query_id"), 3,
        unit_queries=False, unit_index=False,
    ).orderBy("rank").collect()
    assert [(h.row, h.score) for h in hits] == [(1, 6.0), (0, 2.0), (2, 2.0)]


@pytest.mark.parametrize("broadcast", [1 << 26, 1])
def test_multiples_of_a_vector_tie(spark, broadcast):
    """Cosines of whole numbers that are equal used to differ in their last digits."""
    rng = np.random.default_rng(5)
    base = rng.integers(-9, 10, size=(40, 16))
    index = np.concatenate([base * f for f in (7, 3, 1, 11, 5)]).astype("float64")
    queries = rng.integers(-9, 10, size=(25, 16)).astype("float64")
    hits = knn.top_k(
        table(spark, index).repartition(7), table(spark, queries, "query_id"), 10, broadcast_bytes=broadcast
    ).orderBy("query_id", "rank").collect()
    for q in range(25):
        own = [h for h in hits if h.query_id == q]
        dots = base @ queries[q]
        best = np.lexsort((np.arange(40), -np.sign(dots) * dots**2 / (base**2).sum(axis=1)))[:2]
        assert [h.row for h in own] == [int(b) + 40 * i for b in best for i in range(5)]
        assert len({h.score for h in own[:5]}) == 1


def test_a_task_holds_a_tile_of_hits(monkeypatch):
    """However many hits are asked for, they leave the block tile by tile."""
    monkeypatch.setattr(knn, "_TILE", 1000)
    rng = np.random.default_rng(6)
    block = knn.Block(np.arange(100), rng.normal(size=(100, 8)).astype("float32"), True)
    parts = list(block.best(rng.normal(size=(500, 8)), 100_000, True))
    assert max(len(p.row) for p in parts) <= 1000 and sum(len(p.row) for p in parts) == 50_000


def test_many_hits_go_by_balls(spark, vectors, monkeypatch):
    """Few queries with so many hits that their running best would not fit a task."""
    asked = []
    search = balls.BallIndex.search
    monkeypatch.setattr(balls.BallIndex, "search", lambda self, *a: asked.append(1) or search(self, *a))
    hits = knn.top_k(table(spark, vectors), table(spark, vectors[:3], "query_id"), 100_000, broadcast_bytes=1 << 16)
    assert asked and hits.count() == 3 * len(vectors)


@pytest.mark.parametrize("k", [300, 100_000])
def test_many_hits_of_a_small_index_are_not_exchanged(spark, vectors, k):
    """They used to be dealt out by query and stored, which takes far more disk than the vectors."""
    queries = vectors[:350]
    hits = knn.top_k(table(spark, vectors).repartition(5), table(spark, queries, "query_id"), k, broadcast_bytes=1 << 17)
    assert "Window" not in hits._jdf.queryExecution().toString()
    assert hits.schema.simpleString() == "struct<query_id:bigint,rank:int,row:bigint,score:double>"
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.row, r.score))
    for q, want in enumerate(brute(vectors, queries, k)):
        assert [r[:2] for r in got[q]] == [(i + 1, row) for i, (row, _) in enumerate(want)]
        assert np.allclose([r[2] for r in got[q]], [score for _, score in want], atol=1e-12)


@pytest.mark.parametrize("pairs", [1 << 26, 800])
def test_many_hits_of_ids_that_repeat_or_are_null(spark, vectors, monkeypatch, pairs):
    """Vectors of one id are one query, in several tasks if they are many; a missing id stays missing."""
    monkeypatch.setattr(knn, "_TASK_PAIRS", pairs)
    names = [None, 7, 7, 8, None, 9, 7, 10]
    some = vectors[: len(names)] + 0.5
    some = some.astype("float32").astype("float64")
    asked = spark.createDataFrame(
        [(n, [float(x) for x in v]) for n, v in zip(names, some, strict=True)], "query_id long, vec array<float>"
    ).repartition(3)
    hits = knn.top_k(table(spark, vectors), asked, 1000, broadcast_bytes=1 << 17)
    assert ("Window" in hits._jdf.queryExecution().toString()) == (pairs == 800)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.row, r.score))
    whole = brute(vectors, some, 1000)
    for name in set(names):
        found = [(-score, row) for n, own in zip(names, whole, strict=True) if n == name for row, score in own]
        want = sorted(found)[:1000]
        assert [r[:2] for r in got[name]] == [(i + 1, row) for i, (_, row) in enumerate(want)]
        assert np.allclose([r[2] for r in got[name]], [-score for score, _ in want], atol=1e-12)


@pytest.mark.parametrize("k", [30, 150, 100_000])
@pytest.mark.parametrize("tile", [1, 250, 1 << 20])
def test_ranks_whatever_the_batches(monkeypatch, k, tile):
    """An id may go on in the next tile or batch; equal scores go by the row."""
    monkeypatch.setattr(knn, "_TILE", tile)
    monkeypatch.setattr(knn, "_RANK_TILE", tile)
    rng = np.random.default_rng(8)
    index = rng.integers(-1, 2, size=(90, 3)).astype("float32")
    names = pa.array([None, None, 1, 2, 2, 2, 2, 5, 6, 6, 7], pa.int64())
    vecs = rng.integers(-1, 2, size=(len(names), 3)).astype("float32")
    rows = pa.array([10 * i for i in range(90)], pa.int64())
    lists = pa.array(vecs.tolist(), pa.list_(pa.float32()))
    whole = pa.RecordBatch.from_arrays([names, lists], names=["query_id", "vec"])
    want = []
    block = knn.Block(np.arange(90), index, True)
    for name in dict.fromkeys(names.to_pylist()):
        own = [i for i, n in enumerate(names.to_pylist()) if n == name]
        parts = [block.best(vecs[[i]].astype("float64"), 90, True) for i in own]
        found = sorted((-s, 10 * int(r)) for part in parts for h in part for r, s in zip(h.row, h.score, strict=True))
        want += [(name, i + 1, row, -score) for i, (score, row) in enumerate(found[:k])]
    for cuts in ([], [1], [4, 5, 9], range(1, 11)):
        ends = [0, *cuts, len(names)]
        batches = [whole.slice(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
        scan = knn._rank_with(rows, index, k, True, True)(iter(batches))
        got = [tuple(r.values()) for b in scan for r in b.to_pylist()]
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_routes_in_slices(spark, vectors, monkeypatch):
    """Distances to centres are held for some queries at a time; the routes are the same."""
    index = balls.BallIndex.build(table(spark, vectors), part_rows=20)
    queries = table(spark, vectors[:50], "query_id")
    whole = sorted(map(tuple, index.routes(queries, 4)[1].collect()))
    monkeypatch.setattr(balls, "_CELLS", 64)
    assert [s.stop - s.start for s in balls._slices(7, 20)] == [3, 3, 3]
    near = balls._nearest(vectors, index.centres)
    assert (near[0] == np.argmin(((vectors[:, None] - index.centres) ** 2).sum(axis=2), axis=1)).all()
    assert sorted(map(tuple, index.routes(queries, 4)[1].collect())) == whole


def test_tokens_remembered_are_few():
    """A worker used to keep up to a million tokens, which grew with the corpus."""
    from folioforge.operators import embedding

    HashingEncoder(8).encode([" ".join(f"t{i}" for i in range(40_000))])
    assert embedding._token_hash.cache_info().currsize <= 1 << 15


def test_hashing_takes_little_more_than_finding_tokens():
    """Known tokens of an English text: it took over twice the time that finding them takes."""
    from folioforge.operators import embedding

    every = "".join(map(chr, range(256))) + "aß_1ǅ  x2—Éa\u0301·ﬁ٣_"
    for text in [every, "".join(map(chr, range(128))), "A_b-c\x1fD1\n2", "İI ıx", "_", ""]:
        assert embedding._tokens(text) == re.findall(r"[^\W_]+", text.lower())
    texts = [" ".join(f"word{(i * 7 + j) % 500}, The next-one" for j in range(60)) for i in range(400)]

    def seconds(work):
        times = []
        for _ in range(7):
            start = time.perf_counter()
            work()
            times.append(time.perf_counter() - start)
        return min(times)

    found = seconds(lambda: [re.findall(r"[^\W_]+", t.lower()) for t in texts])
    assert seconds(lambda: HashingEncoder().encode(texts)) < 1.5 * found


def test_encoded_matrices_become_lists(spark):
    """Nulls count as empty; a vector stays as it is, not-a-number included."""

    class Lengths:
        def encode(self, texts):
            return np.array([[len(t), np.nan if t == "nan" else 0.5] for t in texts])

    rows = [(i, t) for i, t in enumerate(["a", None, "nan", "four"] * 25)]
    df = spark.createDataFrame(rows, "i long, t string")
    got = {r.i: r.embedding for r in encode_column(df, "t", Lengths, batch_size=7).collect()}
    assert len(got) == 100
    for i, t in rows:
        assert got[i][0] == len(t or "")
        assert np.isnan(got[i][1]) if t == "nan" else got[i][1] == 0.5


def test_no_queries_and_wrong_dimension(spark, vectors):
    none = knn.top_k(table(spark, vectors), spark.createDataFrame([], "query_id long, vec array<float>"), 3)
    assert none.count() == 0
    with pytest.raises(Exception, match="dim"):
        knn.top_k(table(spark, vectors), table(spark, np.ones((1, 3)), "query_id"), 3).collect()


def chunks(spark, texts):
    return spark.createDataFrame(
        [(f"c{i}", "book", i, 0, t) for i, t in enumerate(texts)],
        "id string, book_title string, page_number long, chunk_index int, content string",
    )


def test_index_lifecycle(spark, vectors):
    rows = chunks(spark, ["x"] * 400).withColumnRenamed("id", "chunk_id").join(
        table(spark, vectors, "page_number"), "page_number"
    )
    index = VectorIndex(16)
    with pytest.raises(RuntimeError):
        index.save("/nowhere")
    with pytest.raises(RuntimeError):
        index.search(table(spark, vectors[:1], "query_id"))
    assert index.stats().first().built is False
    index.build(rows, ["page_number"], vector="vec", model_key="bge-small")
    path = new_table_path(spark, "index")
    index.save(path)
    loaded = VectorIndex.load(spark, path)
    s = loaded.stats().first()
    assert (s.built, s.ntotal, s.dimension, s.metadata_rows) == (True, 400, 16, 400)
    assert loaded.self_check()
    hit = loaded.search(table(spark, vectors[7:8], "query_id"), 1).first()
    assert (hit.row, hit.chunk_id, hit.page_number) == (7, "c7", 7)
    with pytest.raises(ValueError, match="Query dim 3 != index dimension 16"):
        loaded.search(table(spark, np.ones((1, 3)), "query_id"))
    with pytest.raises(FileNotFoundError):
        VectorIndex.load(spark, path + "-missing")
    with pytest.raises(Exception, match="Embedding dim 16 != declared dimension 8"):
        VectorIndex(8).build(rows, ["page_number"], vector="vec").table.collect()
    with pytest.raises(ValueError, match="Model mismatch"):
        Retriever(loaded, lambda: HashingEncoder(16), "bge-large")


def test_index_layout(spark, tmp_path):
    """Rows in order stay where they are, hits read the files they lie in, a manifest knows the rest."""
    m = clustered(600, 8, 10)
    rows = table(spark, m, "page").repartitionByRange(12, "page").withColumn("content", F.col("page").cast("string"))
    rows.write.parquet(str(tmp_path / "rows"))
    # A file is a partition: two do not fit one, and none is cut.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        index = VectorIndex(8).build(spark.read.parquet(str(tmp_path / "rows")), ["page"], vector="vec")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = index.table._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert [r.content for r in index.table.orderBy("row").collect()] == [str(i) for i in range(600)]
    assert len(index.files.files) == 12
    index.save(str(tmp_path / "index"))
    loaded = VectorIndex.load(spark, str(tmp_path / "index"))
    hits = spark.createDataFrame([(7,), (8,), (599,)], "row long")
    for one in (index, loaded):
        assert 0 < len(one.files.holding(hits)) <= 2 < len(one.files.files)
        assert one.rows_of(hits).join(hits, "row").count() == 3
        assert one.rows_of(hits.limit(0)).count() == 0
        read = one.rows_of(hits).select(F.input_file_name()).distinct().count()
        assert read <= 2
    stats = loaded.stats()
    assert stats.first().ntotal == 600 and stats.first().dimension == 8
    assert "vec" not in stats._jdf.queryExecution().executedPlan().toString()
    a, b = ({(r.query_id, r["rank"]): r.content for r in x.search(table(spark, m[:9], "query_id"), 3).collect()} for x in (index, loaded))
    assert a == b and len(a) == 27


def test_overlapping_partitions_are_put_in_order(spark):
    rows = spark.createDataFrame([(i * 37 % 100, None if i == 5 else f"k{i % 7}") for i in range(100)], "n long, k string")
    stored, before = stored_in_order(rows.repartition(6), ["k", "n"])
    numbered = with_numbers(stored, before).orderBy("row").collect()
    assert [r.row for r in numbered] == list(range(100))
    assert [(r.k, r.n) for r in numbered] == sorted(((r.k, r.n) for r in numbered), key=lambda x: (x[0] is not None, x))
    assert with_numbers(*stored_in_order(rows.limit(0), ["n"])).count() == 0


def test_retriever(spark):
    texts = ["gradient descent step", "matrix inverse", "hessian matrix", "prior belief"]
    encoder = lambda: HashingEncoder(64)
    rows = embed_chunks(chunks(spark, texts), encoder).withColumnRenamed("id", "chunk_id")
    index = VectorIndex(64).build(rows, ["page_number"])
    r = Retriever(index, encoder)
    best = r.search_text("matrix inverse", 2).collect()
    assert [h.chunk_id for h in best][0] == "c1" and best[0].score == pytest.approx(1, abs=1e-6)
    assert [h["rank"] for h in best] == [1, 2] and best[0].section == ""
    assert r.search_text("  \n", 3).count() == 0
    assert r.search_text("matrix", 50).count() == 4


def test_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting(HashingEncoder):
        def encode(self, texts):
            calls.add(len(texts))
            return super().encode(texts)

    cache = EmbeddingCache(spark, new_table_path(spark, "cache"), key="chunk")
    assert cache.stats().first().total_embeddings == 0
    docs = chunks(spark, [f"text {i}" for i in range(50)])
    first = embed_chunks(docs.limit(20), lambda: Counting(8), cache).collect()
    assert len(first) == 20 and calls.value == 20
    assert cache.hits(docs).count() == 20 and cache.misses(docs).count() == 30
    again = embed_chunks(docs, lambda: Counting(8), cache, batch_size=7)
    assert again.count() == 50 and calls.value == 50
    embed_chunks(docs, lambda: Counting(8), cache).collect()
    assert calls.value == 50
    s = cache.stats().first()
    assert (s.total_embeddings, s.model_dimension) == (50, 8)
    assert s.cache_size_mb == pytest.approx(50 * (32 + 64) / 2**20)
    cache.clear()
    assert cache.stats().first().total_embeddings == 0


def test_content_cache_shares_equal_texts(spark):
    cache = EmbeddingCache(spark, new_table_path(spark, "cache"), "content", "m1")
    docs = chunks(spark, ["same"] * 30 + ["other"])
    rows = embed_chunks(docs, lambda: HashingEncoder(8), cache)
    assert rows.count() == 31 and cache.table().count() == 2
    other = EmbeddingCache(spark, cache.path, "content", "m2")
    assert other.misses(docs).count() == 2


def test_two_writers_of_a_vector(spark):
    """Both saw the miss and both have stored it; a chunk still has one row."""
    cache = EmbeddingCache(spark, new_table_path(spark, "cache"), model_key="m")
    docs = chunks(spark, [f"text {i}" for i in range(20)])
    for _ in range(2):
        cache.add(encode_column(cache.keyed(docs), "content", lambda: HashingEncoder(8)))
    assert cache.table().count() == 20
    rows = embed_chunks(docs, lambda: HashingEncoder(8), cache)
    assert rows.count() == 20 and cache.stats().first().total_embeddings == 20


def test_broken_cache_file(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"), model_key="m")
    docs = chunks(spark, [f"text {i}" for i in range(20)])
    embed_chunks(docs.limit(10), lambda: HashingEncoder(8), cache).collect()
    embed_chunks(docs, lambda: HashingEncoder(8), cache).collect()
    broken = max(tmp_path.glob("cache/vectors-*/batch=*/part-*"), key=lambda p: p.stat().st_size)
    broken.write_bytes(b"not a table")
    with pytest.raises(Exception):
        embed_chunks(docs, lambda: HashingEncoder(8), cache).collect()
    with pytest.warns(UserWarning, match="broken files are lost"):
        saved = cache.repair()
    assert saved < 20
    rows = embed_chunks(docs, lambda: HashingEncoder(8), cache)
    assert rows.filter("embedding IS NULL").count() == 0 and rows.count() == 20


def test_repaired_table_of_answers(spark, tmp_path):
    path, repaired = str(tmp_path / "table"), str(tmp_path / "repaired")
    rows = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], schemas.EMBEDDING_CACHE)
    rows.coalesce(1).write.parquet(path)
    with pytest.warns(UserWarning, match="broken files are lost"):
        assert tables.repair_cache(spark, path, schemas.EMBEDDING_CACHE, repaired) == 2


def entries(n, value=1.0, start=0):
    return [(f"k{i}", [value, float(i)]) for i in range(start, start + n)]


def test_cache_lookups_exchange_nothing_of_the_cache(spark):
    cache = EmbeddingCache(spark, new_table_path(spark, "cache"), model_key="m")
    docs = chunks(spark, [f"text {i}" for i in range(50)])
    embed_chunks(docs.limit(30), lambda: HashingEncoder(8), cache).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, exchanges in ((cache.table(), 0), (cache.stats(), 1), (cache.hits(docs), 1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") + plan.count("SinglePartition") == exchanges, plan
        plan = cache.misses(docs)._jdf.queryExecution().executedPlan().toString()
        # Chunks move by key, once for the join and for dropping repeated keys.
        assert plan.count("Exchange hashpartitioning") == 1
        scan = plan[plan.index("FileScan parquet") :]
        assert "embedding" not in scan.split("ReadSchema")[1].splitlines()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cache_generations(spark):
    """Clearing and compacting beside a reader; a second session finds what the first wrote."""
    path = new_table_path(spark, "cache")
    cache, other = EmbeddingCache(spark, path, buckets=3), EmbeddingCache(spark.newSession(), path, buckets=5)
    cache.clear(), cache.compact()  # nothing there yet
    assert cache.table().count() == 0 and cache.vacuum() == 0
    cache.add(spark.createDataFrame(entries(10), schemas.EMBEDDING_CACHE))
    other.add(other.spark.createDataFrame(entries(10, 2.0, 5), schemas.EMBEDDING_CACHE))
    reading = cache.table()
    assert reading.count() == 15 and cache.log().count() == 20
    first = {r.cache_key: r.embedding[0] for r in cache.table().collect()}
    assert first["k7"] == 1.0 and first["k12"] == 2.0
    other.compact(buckets=7)
    plan = cache.table()._jdf.queryExecution().executedPlan().toString()
    assert cache.log().count() == 15 and "SelectedBucketsCount: 7 out of 7" in plan
    assert {r.cache_key: r.embedding[0] for r in cache.table().collect()} == first
    other.clear()
    assert cache.table().count() == 0
    assert reading.count() == 15  # what was being read stays readable
    other.add(other.spark.createDataFrame(entries(4), schemas.EMBEDDING_CACHE))
    assert cache.stats().first().total_embeddings == 4
    assert cache.vacuum() == 2 and cache.table().count() == 4


def test_two_writers_at_once(spark):
    path = new_table_path(spark, "cache")
    caches = [EmbeddingCache(spark, path) for _ in range(4)]
    caches[0].add(spark.createDataFrame(entries(1), schemas.EMBEDDING_CACHE))
    rows = [spark.createDataFrame(entries(200, float(i), 50 * i), schemas.EMBEDDING_CACHE) for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: caches[i].add(rows[i].repartition(6)), range(4)))
    assert caches[0].table().count() == 350 and caches[1].log().count() == 801


def test_lost_vectors_are_an_error(spark):
    """A cache whose appends get lost must not give chunks without a vector."""

    class Forgetful(EmbeddingCache):
        def add(self, rows):
            pass

    cache = Forgetful(spark, new_table_path(spark, "cache"))
    with pytest.raises(Exception, match="No vector for chunk c"):
        embed_chunks(chunks(spark, ["a", "b"]), lambda: HashingEncoder(8), cache).collect()


def test_models_and_encoder(spark):
    assert embedding_model("bge-large")["dimension"] == 1024
    with pytest.raises(ValueError, match="Unknown model: nope"):
        embedding_model("nope")
    df = spark.createDataFrame([("a b",), (None,), ("b a",)], "t string")
    v = [r.v for r in encode_column(df, "t", lambda: HashingEncoder(8), "v").select("v").collect()]
    assert v[0] == v[2] and v[1] == [0.0] * 8


def clustered(n, dim, groups, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 4
    m = (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.3).astype("float32")
    m[n // 2] = m[1]
    m[3] = 0
    return m.astype("float64")


@pytest.mark.parametrize("k", [1, 5, 70])
def test_balls_give_all_hits_and_read_few(spark, k):
    m = clustered(900, 12, 15)
    index = balls.BallIndex.build(table(spark, m).repartition(5), part_rows=30)
    hits, visits = index.routes(table(spark, m[:60], "query_id"), k)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.row, r.score))
    for q, want in enumerate(brute(m, m[:60], k)):
        assert [r for r, _ in got[q]] == [r for r, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-12)
    report = {r["round"]: r for r in index.report(visits).collect()}
    assert report[1]["queries"] == 60
    if k == 5:
        assert sum(r["visits"] for r in report.values()) < 0.4 * 60 * report[1]["balls"]


def test_balls_with_one_hot_group_and_raw_products(spark):
    """Half of the vectors are one and the same; lengths differ, so bounds use them."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 6)).astype("float32").astype("float64") * rng.integers(1, 9, (300, 1))
    m[::2] = m[0]
    index = balls.BallIndex.build(table(spark, m), unit_index=False, part_rows=20)
    hits = index.search(table(spark, m[:40], "query_id"), 7, unit_queries=False)
    for q, score in enumerate((m[:40, None, :] * m[None]).sum(axis=2)):
        want = np.lexsort((np.arange(300), -score))[:7].tolist()
        assert [r.row for r in hits.filter(F.col("query_id") == q).orderBy("rank").collect()] == want or q > 5
    assert hits.count() == 280


def test_balls_of_nothing(spark):
    index = balls.BallIndex.build(spark.createDataFrame([], VEC))
    assert index.search(table(spark, np.zeros((2, 1)), "query_id"), 3).count() == 0


def test_index_is_read_twice_whatever_the_queries(spark, vectors):
    """More queries are more rows in one exchange, not more scans of the index."""
    index = balls.BallIndex.build(table(spark, vectors), part_rows=50)
    counts = []
    for n in (10, 200):
        hits = index.search(table(spark, vectors[:n], "query_id"), 3)
        counts.append(hits._jdf.queryExecution().executedPlan().toString().count("FileScan parquet"))
    assert counts[0] == counts[1] <= 3
