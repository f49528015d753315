import numpy as np
from pyspark.sql import types as T

from catchwater.llm import embedding_dedup

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("kept", T.StringType())])


def brute(rows):
    """n_links and component of each row, by all pairs."""
    good = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(v)]
    links, parent = {id(g): 0 for g in good}, {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[id(good[a])] += 1
                links[id(good[b])] += 1
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return sorted((i, links[id(g)], find(i)) for g in good for i in [g[0]])


def test_against_all_pairs_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 500)] + rng.normal(size=(500, 16)) * 0.12, rng.normal(size=(300, 16))]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(2000 + k, rows[0][1]) for k in range(30)]  # copies
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows + odd] + [(None, rows[0][1], 1, "clash")], SCHEMA)
    out = embedding_dedup.dedup(table).collect()
    assert len(out) == len(rows) + len(odd) + 1
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out if r["vec_id"] is not None and not 900 <= r["vec_id"] < 906)
    assert got == brute(rows + odd[6:])
    assert all(r["n_links"] == 0 and r["kept"] for r in out if r["vec_id"] is not None and 900 <= r["vec_id"] < 906)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out if r["vec_id"] is not None)
    assert embedding_dedup.dedup(table.limit(0)).count() == 0


def test_recall_over_a_large_shard():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 64))
    x = np.concatenate([base, base[:300] + rng.normal(size=(300, 64)) * 0.05, base[:1] + rng.normal(size=(400, 64)) * 0.05])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)[rng.permutation(2200)]
    graph = embedding_dedup.Graph(x)
    beam = graph.audited(x[:1000], 0.95)
    r, c = graph.within(x, 0.95, beam)
    true = x @ x.T >= 0.95
    assert len(set(zip(r.tolist(), c.tolist(), strict=True))) == len(r)
    assert true[r, c].sum() / true.sum() >= 0.99


def test_small_graphs():
    for n in (1, 2, 3, 17):
        x = np.eye(32, dtype=np.float32)[:n]
        r, c = embedding_dedup.Graph(x).within(x, 0.9, 8)
        assert sorted(zip(r.tolist(), c.tolist(), strict=True)) == [(k, k) for k in range(n)]


def skewed(dense: int, pairs: int, alone: int, seed: int = 8):
    """Unit vectors, shuffled: one dense group, pairs and lone ones; and which kind each is (0, 1, 2)."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(1 + pairs + alone, 64))
    near = lambda x, n: x + rng.normal(size=(n, 64)) * 0.05
    x = np.concatenate([near(base[:1], dense), base[1 : pairs + 1], near(base[1 : pairs + 1], pairs), base[pairs + 1 :]])
    kind = np.repeat([0, 1, 2], [dense, 2 * pairs, alone])
    order = rng.permutation(len(x))
    return (x / np.linalg.norm(x, axis=1)[:, None])[order], kind[order]


def test_a_dense_group_does_not_hide_missed_pairs():
    x, kind = skewed(300, 100, 100)

    class Missing(embedding_dedup.Graph):
        """Misses the partners of small groups until the beam is 100 wide."""

        def within(self, q, threshold, beam):
            r, c = super().within(q, threshold, beam)
            keep = (kind[c] == 0) | (np.einsum("kd,kd->k", q[r], x[c]) > 0.99999) | (beam >= 100)
            return r[keep], c[keep]

    assert Missing(x).audited(x[:400], 0.95) >= 100
    assert embedding_dedup.Graph(x).audited(x[:400], 0.95, own=np.arange(400)) <= len(x)


def table(x, ids):
    import pyarrow as pa

    n = len(x)
    return pa.table({"dim": [x.shape[1]] * n, "shard": [0] * n, "slice": [0] * n, "mixed": list(range(n)), "vec_id": ids, "copies": [1] * n, "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))})


def links(members, queries):
    out = embedding_dedup._links(embedding_dedup.Shard(embedding_dedup._shard(table(*members), 0.95)), embedding_dedup._slice(table(*queries)), 0.95)
    return out.to_pylist()


def test_many_queries_of_a_shard():
    x, _ = skewed(20, 20, 8240)
    ids = np.arange(len(x))
    rows = links((x[:50], ids[:50]), (x, ids))
    near = x @ x[:50].T >= 0.95
    near[ids[:50], ids[:50]] = False
    assert sum(r["n_links"] for r in rows) == near.sum() == sum(r["n_back"] for r in rows)


def test_a_link_found_from_one_end_counts_for_both(monkeypatch):
    x, kind = skewed(0, 30, 10)
    true = embedding_dedup.Graph.near
    small = {x[a].astype(np.float32).astype(np.float64).round(4).tobytes() for a in range(len(x)) if any(b > a and x[a] @ x[b] >= 0.95 for b in range(len(x)))}

    def one_way(self, q, threshold, beam):
        deaf = np.array([v.astype(np.float64).round(4).tobytes() in small for v in q])
        for r, c, s in true(self, q, threshold, beam):
            yield r[~deaf[r]], c[~deaf[r]], s[~deaf[r]]

    monkeypatch.setattr(embedding_dedup.Graph, "near", one_way)
    monkeypatch.setattr(embedding_dedup.Graph, "audited", lambda *a, **k: 48)
    found = {}
    for r in links((x, np.arange(len(x))), (x, np.arange(len(x)))):
        found.setdefault(r["vec_id"], []).append(max(r["n_links"], r["n_back"]))
    assert {k: max(v) for k, v in found.items()} == {k: 1 for k in np.flatnonzero(kind == 1).tolist()}


def test_dense_groups_are_followed_through_the_graph():
    """Each query of a group far wider than the beam finds all of it, and no comparison is with the whole shard."""
    x, kind = skewed(700, 200, 900)
    graph, looked = embedding_dedup.Graph(x), []
    true = embedding_dedup.Graph._reached

    def watched(self, q, start, threshold):
        out = true(self, q, start, threshold)
        looked.append(len(out))
        return out

    embedding_dedup.Graph._reached = watched
    try:
        r, c = graph.within(x, 0.95, 48)
    finally:
        embedding_dedup.Graph._reached = true
    want = x @ x.T >= 0.95
    got = np.zeros_like(want)
    got[r, c] = True
    assert (got >= want).mean(1)[kind == 0].min() == 1.0 and (got & want).sum() / want.sum() >= 0.999
    assert looked and max(looked) < len(x) / 2


def test_chains_unite(spark):
    """Paths whose ids run 1-4-3-2: each vector is linked with its neighbours only, and all four are one component."""
    rng, rows = np.random.default_rng(4), []
    for k in range(200):
        a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        for step, place in enumerate((1, 4, 3, 2)):
            rows.append((4 * k + place, (np.cos(np.radians(15 * step)) * a + np.sin(np.radians(15 * step)) * b).astype(np.float32).tolist()))
    frame = spark.createDataFrame([(i, v, 1, "") for i, v in rows], SCHEMA)
    want = brute(rows)
    for shards in (1, 6):
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(frame, shards=shards).collect()) == want


def test_common_vectors_in_parts(spark):
    """Copies of common vectors meet what their representative has in several tasks, with the same rows."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 16)).astype(np.float32)
    rows = [(k, base[k % 40 if k % 3 else 5].tolist()) for k in range(240)] + [(300 + k, (base[k] * np.float32(1.0001)).tolist()) for k in range(10)]
    frame = spark.createDataFrame([(i, v, 1, "") for i, v in rows], SCHEMA)
    for hot in (4, embedding_dedup.HOT):
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(frame, hot=hot).collect()) == brute(rows)


def test_more_vectors_than_a_block(spark, tmp_path):
    """9,000 distinct vectors through the query, two blocks of a slice and more, against all pairs."""
    from catchwater.llm import queries

    x, _ = skewed(400, 900, 6800)
    x = x.astype(np.float32)
    spark.createDataFrame([(k, v.tolist(), 1, "") for k, v in enumerate(x)], SCHEMA).drop("kept").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {r["vec_id"]: r for r in queries.op4_embedding_dedup(spark, str(tmp_path)).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    n, parent = np.zeros(len(y), int), list(range(len(y)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for lo in range(0, len(y), 500):
        near = y[lo : lo + 500] @ y.T >= 0.95
        near[np.arange(len(near)), lo + np.arange(len(near))] = False
        n[lo : lo + 500] = near.sum(1)
        for a, b in zip(*np.nonzero(near), strict=True):
            low, high = sorted((find(lo + a), find(b)))
            parent[high] = low
    assert len(y) > 8192 and len(out) == len(y)
    assert np.mean([out[k]["n_links"] == n[k] for k in range(len(y))]) >= 0.999
    assert np.mean([out[k]["component_id"] == find(k) for k in range(len(y))]) >= 0.999


def test_a_step_of_the_search_holds_little_whatever_the_shard():
    """Queries go through the graph a few at a time: what a step holds does not outgrow a core's cache with the shard."""
    import tracemalloc

    x, _ = skewed(200, 900, 2000)
    graph, peak = embedding_dedup.Graph(x), []
    for q in (x[:256], x[:2048]):
        tracemalloc.start()
        found = sum(len(r) for r, _, _ in graph.near(q, 0.95, 48))
        peak.append(tracemalloc.get_traced_memory()[1] - 2 * q.nbytes)
        tracemalloc.stop()
        assert found >= len(q)  # each finds itself at least
    assert max(peak) < 10 << 20


def test_a_search_meets_a_point_once():
    """Points that several expanded ones lead to come once in the beam, the nearest first."""
    x, _ = skewed(300, 300, 900)
    graph = embedding_dedup.Graph(x)
    q = np.ascontiguousarray(x, np.float32)
    ids, sims = graph._search(graph.layers[-1], q, graph._entry(q), 48)
    order = np.sort(ids, 1)
    assert not ((order[:, 1:] == order[:, :-1]) & (order[:, 1:] >= 0)).any()
    assert (np.diff(sims, axis=1) <= 0).all() and (ids >= 0).all()
    assert np.allclose(np.einsum("qd,qwd->qw", q, graph.x[ids]), sims, atol=1e-5)


def test_points_that_the_graph_has_lost_are_found():
    """A point to which no link leads still meets its partners, once, and asks for no wider beam."""
    x, kind = skewed(100, 400, 500)
    graph = embedding_dedup.Graph(x)
    cut = np.flatnonzero(kind[graph.order] == 1)[-60:]
    cut = cut[cut >= len(graph.layers[-2])]  # not on a higher layer
    for links in graph.layers:
        links[np.isin(links, cut)] = -1
    graph.apart = graph._lost()
    assert len(cut) > 20 and set(cut.tolist()) <= set(graph.apart.tolist())
    graph = embedding_dedup.Graph.unpacked(graph.packed())
    r, c = graph.within(x, 0.95, 48)
    want = x @ x.T >= 0.95
    assert len(set(zip(r.tolist(), c.tolist(), strict=True))) == len(r) == want.sum() and want[r, c].all()
    assert graph.audited(x, 0.95, own=np.arange(len(x))) == 48
