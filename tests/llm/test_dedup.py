"""SimHash, embeddings and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftledger.llm import simhash, vectors
from driftledger.llm.components import connected_components


def reached(n, linked):
    """The smallest position that each of n reaches by links (i, j)."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def bits_of(text):
    """The fingerprint, word for word as it is defined."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in lower).split("\n") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", None, "one", "Two words", "a b c d", "A B C D e", "é x y\x1cz w v", "t " * 5000, "x\ty\x0bz\x0cw\rv\nu", "a b c d", "ÀB c D E"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprints_follow_the_definition(text):
    assert simhash.fingerprint(text) == bits_of(text)


def test_shingle_hashes_are_those_of_spark(spark):
    for s in ("a b c d", "é ü ß x", "x" * 100):
        got = spark.range(1).select(F.xxhash64(F.lit(s))).first()[0]
        assert got % (1 << 64) == xxhash.xxh64_intdigest(s.encode(), 42)


def test_near_duplicate_documents(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["la", "lo", "mi", "no", "pa", "re", "si", "tu"], 300)) for _ in range(12)]
    texts = TEXTS + base + [b.replace("la", "xx", 1) for b in base] + base[:4] * 3 + [b + " end" for b in base]
    rows = [(k + 1, t, "clash", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "one", None, 1)], "doc_id long, text string, fp string, component long")
    got = simhash.near_duplicates(docs).collect()
    fps = [bits_of(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = {k + 1: r + 1 for k, r in enumerate(reached(len(fps), links))}
    assert len(got) == len(rows) + 2
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("blocks", "cell_rows"), [(6, 20_000), (7, 20_000), (6, 7), (5, 20_000)])
def test_grid_join_finds_all_links_in_sparse_and_crowded_cells(spark, blocks, cell_rows):
    rng = np.random.default_rng(blocks)
    flips = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    some = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    crowd = [flips(some[0], int(n)) for n in rng.integers(0, 7, 150)]
    near = [flips(x, int(n)) for x in some[1:] for n in rng.integers(1, 7, 3)]
    fps = sorted({*some, *crowd, *near, 0, 1, (1 << 64) - 1, (1 << 64) - 3})
    signed = [(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fps)]
    edges = simhash.fingerprint_links(spark.createDataFrame(signed, "node long, fp long"), 4, cell_rows, blocks).collect()
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in edges)
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert reached(len(fps), edges) == reached(len(fps), brute)


def test_popcounts_are_a_lower_bound(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    pops = lambda v: np.array([[int(a >> (2 * s) & 3).bit_count() for s in range(32)] for a in map(int, v)])
    manhattan = np.abs(pops(x) - pops(y)).sum(axis=1)
    assert (np.bitwise_count(simhash._codes(x) ^ simhash._codes(y)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(x ^ y)).all()
    codes = spark.createDataFrame([(int(v),) for v in x[:20]], "fp long").select(simhash.popcount_code(F.col("fp"))).collect()
    assert [r[0] for r in codes] == simhash._codes(x[:20]).view(np.int64).tolist()


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 130)]
    edges = [*chain, (7, 3), (3, 9), (9, 7), (5, 5), (None, 4), (7, 3), (50, 40), (40, 60), (60, 41), (1, 1000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 131)} | {3: 3, 7: 3, 9: 3, 40: 40, 41: 40, 50: 40, 60: 40, 1: 1, 1000: 1}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shard_rows", [2000, 64])
def test_near_duplicate_vectors(spark, shard_rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x = np.concatenate([x, x[:40] + rng.normal(size=(40, 16)) * 0.05, np.repeat(x[50:51], 30, axis=0), x[51:52] + rng.normal(size=(150, 16)) * 0.1, x[:5] * 3])
    x = x.astype(np.float32).astype(float)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] * 16, 1), (9005, [1.0, 2.0], 1), (9006, [], 1), (9007, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, shard_rows=shard_rows).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    assert len(got) == len(rows) + len(odd)
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= close.sum(axis=1)).all() and found.sum() >= 0.99 * close.sum()
    want = reached(len(x), list(zip(*np.nonzero(close), strict=True)))
    assert np.mean([got[k].component_id == want[k] for k in range(len(x))]) > 0.99
    assert all(got[k].kept == (got[k].component_id == k) for k in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, *_ in odd)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(df).count() == 0
    lone = spark.createDataFrame([(None, [1.0]), (4, [2.0]), (3, [1.0]), (4, [2.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(lone).collect()) == [(-1, 0, None, False), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False)]


def test_recall_is_measured_where_links_are_rare(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 24))
    x = np.concatenate([x, x[:3] + rng.normal(size=(3, 24)) * 0.01]).astype(np.float32)
    points = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(x)], "node long, size long, vector array<float>")
    linked = spark.createDataFrame([(k, 1) for k in (0, 1500, 1, 1501, 2)], "node long, links long")
    assert abs(vectors._recall(points, linked, len(x), 0.95) - 5 / 6) < 1e-9  # all points are looked at until links are met
    assert vectors._recall(points.where("node < 1500"), linked, 1500, 0.95) is None


def test_graph_search_finds_dense_and_sparse_groups():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(900, 32)), rng.normal(size=(1, 32)) + rng.normal(size=(250, 32)) * 0.1])
    x = np.concatenate([x, x[:60] + rng.normal(size=(60, 32)) * 0.05])
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.build_graph(v)
    assert graph.shape[1] == 2 * vectors.DEGREE and not (graph == np.arange(len(v))[:, None]).any()
    q, h = vectors.range_search(v, graph, v, 0.95)
    found, want = set(zip(q.tolist(), h.tolist(), strict=True)), set(zip(*(a.tolist() for a in np.nonzero(v @ v.T >= 0.95)), strict=True))
    assert found <= want and len(found) >= 0.999 * len(want)


def test_many_centroids_are_found_by_groups():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = vectors.fit_centroids(x, 700)
    near, want = vectors.nearest_centroids(x, c, 2, vectors.grouped(c)), vectors.nearest_centroids(x, c, 2, None)
    assert (near[:, :1] == want).any(axis=1).mean() > 0.9 and (np.diff(near, axis=1) > 0).all()


def test_recall_is_measured_where_links_are_rare(spark):
    """No two of these vectors link: the probes tell what a search would find, and nothing links through them."""
    import numpy as np

    from driftledger.llm import vectors

    rows = np.random.default_rng(4).standard_normal((3000, 32))
    table = spark.createDataFrame([(k, x) for k, x in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    got = vectors.near_duplicates(table)
    assert got.where("n_links <> 0 or component_id <> vec_id or not kept").count() == 0 and got.count() == 3000
    points = table.selectExpr("vec_id as node", "1L as size", "embedding as vector")
    _, edges, reached = vectors._links_of(points, 3000, 32, 0.95, 2, 500)
    assert edges.isEmpty() and reached >= 0.9


def test_probes_are_within_reach():
    import numpy as np
    import pandas as pd

    from driftledger.llm.vectors import _probes, unit

    v = np.random.default_rng(1).standard_normal((40, 8))
    got = unit(list(_probes(pd.DataFrame({"vector": v.tolist()}), 0.95)))
    assert ((got * unit(v.tolist())).sum(axis=1) >= 0.95).all() and ((got @ unit(v.tolist()).T >= 0.95).sum() >= 40)


def test_one_search_is_enough_where_points_lie_between_many_shards(spark, monkeypatch):
    """Vectors without clusters and pairs among them whose cosine is little over the limit: a search that had to be made again
    with more overlap took CPU seconds that grew faster than the input."""
    rng = np.random.default_rng(12)
    x = vectors.unit(list(rng.standard_normal((2400, 24))))
    aside = rng.standard_normal((600, 24))
    aside = vectors.unit(list(aside - (aside * x[:600]).sum(axis=1, keepdims=True) * x[:600]))
    x = np.concatenate([x, 0.905 * x[:600] + np.sqrt(1 - 0.905**2) * aside])
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    searches, search = [], vectors._links_of
    monkeypatch.setattr(vectors, "_links_of", lambda *a: searches.append(a) or search(*a))
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(table, least=0.9, shard_rows=120).collect()}
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[k] for k in range(len(x))])
    assert len(searches) == 1
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_shards_within_the_margin_are_asked():
    rng = np.random.default_rng(13)
    x = vectors.unit(list(rng.standard_normal((500, 16))))
    c = vectors.fit_centroids(x, 40)
    homes, asked = vectors.homes_and_asked(x, c, 2, None, 0.1)
    near = x @ c.T
    apart = np.linalg.norm(c[:, None] - c[None], axis=2)
    for k in range(len(x)):
        first = near[k].argmax()
        assert asked[k].tolist() == np.flatnonzero(near[k, first] - near[k] <= 0.1 * apart[first]).tolist()
        assert first in asked[k] and first in homes[k]
    assert [len(a) for a in vectors.homes_and_asked(x, c, 2, None, 0.0)[1]] == [1] * len(x)
    margin = vectors.fit_margin(x, c, 2, 0.95)
    y = vectors._near(x, 0.95)
    share = np.mean([bool({*a.tolist()} & {*h.tolist()}) for a, h in zip(vectors.homes_and_asked(y, c, 1, None, margin)[1], homes, strict=True)])
    assert share >= vectors.MARGIN_SHARE


def test_shards_clustered_again_are_asked_for_what_their_parts_hold(spark):
    rng = np.random.default_rng(14)
    x = vectors.unit(list(rng.standard_normal((900, 16))))
    y = vectors._near(x[:300], 0.95)
    points = [(k, 1, v) for k, v in enumerate([*x.tolist(), *y.tolist()])]
    df = spark.createDataFrame([*points, (-1, 0, x[0].tolist())], "node long, size long, vector array<double>")
    margin = 2 * float(np.sqrt((1 - 0.95**2) / 16))
    dealt = vectors._dealt(df, np.stack([x[0], -x[0]]), 1, margin)
    got = {r.node: r for r in vectors._dealt_again(dealt, 2, margin, 100).collect()}
    assert len(got) == len(points) + 1 and got[-1].shards == [] and got[-1].asked
    assert all(len(got[k].shards) == 2 and got[k].asked == sorted(set(got[k].asked)) for k in range(len(points)))
    assert len({s for r in got.values() for s in r.shards}) > 12
    assert np.mean([bool({*got[900 + k].asked} & {*got[k].shards}) for k in range(300)]) > 0.97


def test_few_shards_are_asked_among_many_centroids():
    """With more than 512 centroids a point's nearest was looked for in some groups only, and no margin but the widest found what
    two close points have in common: each asked hundreds of shards."""
    rng = np.random.default_rng(15)
    x = vectors.unit(list(rng.standard_normal((3000, 32))))
    c = vectors.fit_centroids(x, 700)
    margin = vectors.fit_margin(x, c, 2, 0.95)
    homes, asked = vectors.homes_and_asked(x, c, 2, vectors.grouped(c), margin)
    assert np.mean([len(a) for a in asked]) < 40
    either = vectors.fit_margin(x, c, 2, 0.95, mutual=True)
    assert either < margin
    y = vectors._near(x, 0.95)
    (h, a), (g, b) = ([[{*r.tolist()} for r in z] for z in vectors.homes_and_asked(some, c, 2, None, either)] for some in (x, y))
    assert np.mean([bool(h[k] & b[k]) or bool(g[k] & a[k]) for k in range(len(x))]) >= vectors.MARGIN_SHARE


def test_a_pair_is_counted_once_whichever_of_its_points_asks():
    import pandas as pd

    v = [[1.0, 0.0], [0.99, 0.05], [0.98, 0.1]]
    rows = [(1, 2, v[0], [5, 6], [5, 7]), (2, 3, v[1], [7, 8], [5]), (3, 1, v[2], [5, 7], [5, 7])]
    total = {k: 0 for k in (1, 2, 3)}
    for shard in (5, 6, 7, 8):
        frame = pd.DataFrame(rows, columns=["node", "size", "vector", "shards", "asked"]).assign(shard=shard)
        frame["is_node"], frame["is_query"] = ([shard in x for x in frame[c]] for c in ("shards", "asked"))
        ids = frame["node"][frame["is_node"]].tolist()
        lists = pd.DataFrame({"node": ids, "next": [np.array([j for j in ids if j != i], dtype=np.int64) for i in ids]})
        frame = frame[frame["is_node"] | frame["is_query"]]
        for node, links in vectors._links(frame, lists, 0.95)[["node", "links"]].itertuples(index=False):
            total[node] += links
    assert total == {1: 4, 2: 3, 3: 5}


def test_vectors_lie_on_disk_once_and_move_in_waves(spark, monkeypatch):
    """The vectors' copies in the shared folder go when they are read no more, and waves, shards that are parted and graphs that
    meet part by part find what one round does."""
    import pathlib
    import uuid

    from driftledger.llm import common

    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(size=(700, 12)), rng.normal(size=(1, 12)) + rng.normal(size=(200, 12)) * 0.02])
    x = vectors.unit(list(np.concatenate([x, x[:100] + rng.normal(size=(100, 12)) * 0.02, x[:20]])))
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    folder = pathlib.Path(f"/tmp/checkpoints/{uuid.uuid4().hex}")
    monkeypatch.setattr(vectors, "WAVE_BYTES", 1)
    monkeypatch.setattr(vectors, "new_folder", lambda spark, name: f"file://{folder}/{name}-{uuid.uuid4().hex}")
    waves, make = [], vectors._waves
    monkeypatch.setattr(vectors, "_waves", lambda *a: waves.append(make(*a)) or waves[-1])
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(table, shard_rows=64).collect()}
    assert max(waves) > 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == before
    left = {d.name.rsplit("-", 1)[0] for d in folder.iterdir()}
    assert "vectors-links" in left and not left & {"vectors-points", "vectors-first", "vectors-dealt", "vectors-lists"}
    assert common.new_folder is not vectors.new_folder
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_a_pair_counts_for_both_if_either_finds_it():
    """39 finds 0, which doesn't find 39."""
    import pandas as pd

    v = np.zeros((40, 40))
    v[np.arange(40), np.arange(40)] = 1
    v[39] = 0.99 * v[0] + np.sqrt(1 - 0.99**2) * v[1]
    frame = pd.DataFrame({"node": range(40), "size": 1, "vector": v.tolist(), "shards": [[5]] * 40, "asked": [[5]] * 40, "shard": 5, "is_node": True, "is_query": True})
    lists = pd.DataFrame({"node": [39], "next": [np.array([0])]})
    for size in (vectors.SQUARE_ROWS, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(vectors, "medoids", lambda x: np.array([20]))
            patch.setattr(vectors, "range_search", lambda v, graph, q, least, e: (np.array([39]), np.array([0])))
            patch.setattr(vectors, "SQUARE_ROWS", size)
            got = vectors._links(frame, lists, 0.95).set_index("node")["links"].to_dict()
        assert got == ({0: 1, 39: 1} if size > 1 else {39: 1})
