"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping cluster shards.

Equal vectors are one point. Points are dealt to the shards of their nearest centroids, several each; a shard that is too large
is clustered again. In each shard a graph grows: points are inserted in batches, each searched from the medoids among those
before it, its neighbours pruned from what the search met so that no kept neighbour makes another superfluous, with edges both
ways; a second round lets all points meet. A point's lists from all its shards are united. Each point is then searched for in all
shards whose centroids are nearly its nearest: how nearly is fitted, before any graph is built, on vectors made at the limit of
cosine, so that of two such vectors one at least asks a shard that holds the other. A search follows the united lists from the
medoids: greedily towards the point first, then to everything in range, as long as points in range have neighbours not seen. Each
pair that is found is verified in double precision and counted, for both of its points, in the first of the shards that it can be
found in. An audit compares the links of a sample with brute force over all points; where it finds too few, the shards are made
to overlap more. Vectors are stored once and go to their shards in waves of these, so that the disk doesn't hold all copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import brief_shuffles, new_folder, removed, small_batches, stored, stored_in
from .components import connected_components

#: Points that centroids are fitted on, within SAMPLE_BYTES; rows of centroids that are fitted at once.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 128 << 20
#: Points that recall is audited on in expectation: more while they have fewer links than AUDIT_LINKS, up to AUDIT_MOST.
AUDIT_ROWS, AUDIT_LINKS, AUDIT_MOST = 256, 200, 32_768
#: Probes: vectors made at a cosine from the limit up to nearly 1 from sampled ones, which the search is asked for too. They are no
#: points, so that nothing links through them; their ids are the lowest that there are.
PROBES, FIRST_PROBE = 256, -(1 << 63)
#: Points of a shard, for vectors of up to a few thousand numbers; shards of twice as many are clustered again, and what
#: that can't part is cut into parts of this size.
SHARD_ROWS = 2_000
#: Centroids, each of which a point is compared with; beyond them shards grow, up to SHARD_BYTES of vectors in double precision.
MAX_CENTROIDS, SHARD_BYTES = 16_384, 64 << 20
#: Vectors near sampled ones that the margin is fitted on, and in how many of such cases a shard that holds the one has to be asked
#: for the other.
MARGIN_ROWS, MARGIN_SHARE = 16_384, 0.9998
#: Points of a graph for which it is noted, pair by pair, who found whom: a byte a pair.
SQUARE_ROWS = 8_192
#: Bytes of vectors that are shuffled at once, or as many as all points have, where these are more.
WAVE_BYTES = 64 << 20
#: The numbers of vectors as Parquet names them: they hardly repeat.
PLAIN = "vector.list.element"
#: Neighbours in a list, those of a pool that they are pruned from, and how much nearer one has to be to make another superfluous.
DEGREE, POOL, ALPHA = 16, 24, 1.2


def unit(rows: list) -> np.ndarray:
    """The rows as unit vectors in double precision."""
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 3) -> np.ndarray:
    """k unit centroids of unit vectors by k-means from spread points of x."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = nearest_centroids(x, c, 1, grouped(c))[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        norm = np.sqrt((total * total).sum(axis=1))
        c[norm > 1e-9] = total[norm > 1e-9] / norm[norm > 1e-9, None]
    return c


def grouped(c: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(leaders, members): about the square root of the centroids as leaders, and each one's centroids, -1 beyond; None for up to
    MAX_CENTROIDS, which are compared one by one: the nearest is often in none of the nearest groups, and what two close points
    have in common is then found by a very wide margin only."""
    if len(c) <= MAX_CENTROIDS:
        return None
    lead = c[np.linspace(0, len(c) - 1, int(len(c) ** 0.5)).astype(int)]
    of = np.concatenate([(c[k : k + 4096] @ lead.T).argmax(axis=1) for k in range(0, len(c), 4096)])
    order = np.argsort(of, kind="stable")
    place = np.arange(len(c)) - np.searchsorted(of[order], of[order])
    members = np.full((len(lead), int(place.max()) + 1), -1)
    members[of[order], place] = order
    return lead, members


def nearest_centroids(x: np.ndarray, c: np.ndarray, n: int, groups: tuple[np.ndarray, np.ndarray] | None, probes: int = 8) -> np.ndarray:
    """The numbers of the n nearest centroids of each point, ascending; of the centroids of its nearest groups, given these."""
    return homes_and_asked(x, c, n, groups, None, probes)[0]


def homes_and_asked(x: np.ndarray, c: np.ndarray, n: int, groups: tuple[np.ndarray, np.ndarray] | None, margin: float | None, probes: int = 8) -> tuple[np.ndarray, list]:
    """(homes, asked): nearest_centroids, and the numbers, ascending, of the centroids that a step of margin towards them makes
    nearer than the nearest one; nothing asked without a margin."""
    out, asked = np.empty((len(x), n), dtype=np.int64), []
    x, own = x.astype(np.float32), c.astype(np.float32)
    step = max(1, (2 << 20) // (max(len(c), 16 * x.shape[1]) if groups is None else 2 * probes * groups[1].shape[1] * x.shape[1]))
    for k in range(0, len(x), step):
        some = x[k : k + step]
        rows = np.arange(len(some))
        if groups is None:
            of, near = np.broadcast_to(np.arange(len(c)), (len(some), len(c))), some @ own.T
        else:
            lead, members = groups
            m = min(probes, len(lead))
            of = members[np.argpartition(-(some @ lead.T), m - 1, axis=1)[:, :m]].reshape(len(some), -1)
            near = np.where(of < 0, -np.inf, np.matmul(own[of], some[:, :, None])[:, :, 0])
        left = near.copy()
        for j in range(n):
            best = left.argmax(axis=1)
            out[k : k + step, j] = of[rows, best]
            left[rows, best] = -np.inf
        if margin is not None:
            behind, first = near.max(axis=1)[:, None] - near, of[rows, near.argmax(axis=1)]
            row, at = np.nonzero(behind <= 2 * margin)  # unit centroids are 2 apart at most
            to = of[row, at]
            apart = np.sqrt(((c[to] - c[first[row]]) ** 2).sum(axis=1))
            close = behind[row, at] <= margin * apart
            row, to = row[close], to[close]
            order = np.lexsort((to, row))
            asked += np.split(to[order], np.searchsorted(row[order], rows[1:]))
    return np.sort(out, axis=1), asked


def robust_prune(v: np.ndarray, of: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each of the points, up to degree of its pool: the nearest first, each dropping those that it is alpha times nearer
    to than the point is; what room is left gets the nearest of the dropped ones, as the points of a dense group would else
    hang on its centre alone. pool and the result hold places in v, -1 for none."""
    out = np.full((len(of), degree), -1)
    step = max(1, (4 << 20) // (pool.shape[1] * (pool.shape[1] + v.shape[1])))
    for at in range(0, len(of), step):
        own, some = of[at : at + step], pool[at : at + step]
        p, rows = v[some], np.arange(len(own))
        far = np.maximum(2 - 2 * np.matmul(p, v[own][:, :, None])[:, :, 0], 0)
        between = np.maximum(2 - 2 * np.matmul(p, p.transpose(0, 2, 1)), 0) * (alpha * alpha)
        far[(some < 0) | (some == own[:, None])] = np.inf
        left = far.copy()
        for k in range(degree):
            best = far.argmin(axis=1)
            alive = np.isfinite(far[rows, best])
            if not alive.any():
                break
            out[at : at + step][alive, k] = some[rows, best][alive]
            far[(between[rows, best] <= far) & alive[:, None]] = np.inf
            far[rows, best] = left[rows, best] = np.inf
        dropped = np.argsort(left, axis=1)[:, :degree]
        kept = out[at : at + step]
        free = np.cumsum(kept < 0, axis=1) - 1  # the n-th free place gets the n-th nearest of the dropped
        n = min(degree, pool.shape[1])
        fill = np.where(np.isfinite(np.take_along_axis(left, dropped, axis=1)), np.take_along_axis(some, dropped, axis=1), -1)
        pick = np.take_along_axis(fill, np.clip(free, 0, n - 1), axis=1)
        out[at : at + step] = np.where((kept < 0) & (free < n), pick, kept)
    return out


def medoids(v: np.ndarray) -> np.ndarray:
    """The places of the points nearest to the centroids of about the square root of the points' number of clusters."""
    c = fit_centroids(v, max(1, int(len(v) ** 0.5)))
    return np.unique((v @ c.T).argmax(axis=0))


def greedy_search(v: np.ndarray, graph: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int, seen: np.ndarray, expand: int = 4) -> tuple[np.ndarray, np.ndarray, list]:
    """(places, cosines, met): the width nearest points that a beam from the nearest entries finds for each query, -1 for none,
    and all (query, place, cosine) that it looked at. seen, (queries, points), is filled in."""
    n, m, known = len(q), len(v), min(len(entries), width)
    place, near = np.full((n, width), -1, dtype=graph.dtype), np.full((n, width), -2, dtype=v.dtype)
    begin = q @ v[entries].T
    top = np.argpartition(-begin, known - 1, axis=1)[:, :known]
    place[:, :known], near[:, :known] = entries[top], np.take_along_axis(begin, top, axis=1)
    seen[:, entries] = True
    met = [(np.repeat(np.arange(n), len(entries)), np.tile(entries, n), begin.ravel())]
    live, p, s, o, flat = np.arange(n), place, near, place >= 0, seen.reshape(-1)  # those that go on, and their rows
    while len(live):
        pick = np.argpartition(np.where(o, -s, 3), min(expand, width - 1), axis=1)[:, :expand]
        some = np.take_along_axis(o, pick, axis=1).any(axis=1)
        if not some.all():
            place[live[~some]], near[live[~some]] = p[~some], s[~some]
            live, p, s, o, pick = live[some], p[some], s[some], o[some], pick[some]
            if not len(live):
                break
        pick += np.arange(len(live))[:, None] * width
        going = o.reshape(-1).take(pick).ravel()
        o.reshape(-1)[pick] = False
        to = graph.take(p.reshape(-1).take(pick).ravel(), axis=0)
        to[~going] = -1
        to, base = to.reshape(len(live), -1), (live * m)[:, None]
        to[flat.take(base + np.maximum(to, 0))] = -1
        to.sort(axis=1)
        to[:, 1:][to[:, 1:] == to[:, :-1]] = -1
        new = np.flatnonzero(to >= 0)
        r, found = new // to.shape[1], to.reshape(-1)[new]
        flat[base[r, 0] + found] = True
        cosine = np.full(to.shape, -2, dtype=v.dtype)
        cosine.reshape(-1)[new] = np.einsum("ij,ij->i", q.take(live[r], axis=0), v.take(found, axis=0))
        met.append((live[r], found, cosine.reshape(-1)[new]))
        p, s, o = np.concatenate([p, to], axis=1), np.concatenate([s, cosine], axis=1), np.concatenate([o, to >= 0], axis=1)
        top = np.argpartition(-s, width - 1, axis=1)[:, :width] + np.arange(len(live))[:, None] * p.shape[1]
        p, s, o = (x.reshape(-1).take(top) for x in (p, s, o))
    return place, near, met


def _link_back(v: np.ndarray, graph: np.ndarray, of: np.ndarray) -> None:
    """Give each neighbour of these points an edge back, where it has room; else it is pruned anew."""
    width = graph.shape[1]
    source, column = np.nonzero(graph[of] >= 0)
    target, source = graph[of][source, column], of[source]
    near = np.einsum("ij,ij->i", v[source], v[target])
    order = np.lexsort((-near, target))
    source, target = source[order], target[order]
    at = np.arange(len(target)) - np.searchsorted(target, target)
    source, target, at = source[at < width], target[at < width], at[at < width]
    who = np.unique(target)
    pool = np.full((len(who), 2 * width), -1)
    pool[:, :width] = graph[who]
    pool[np.searchsorted(who, target), width + at] = source
    pool = np.sort(pool, axis=1)[:, ::-1]
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    pool = np.sort(pool, axis=1)[:, ::-1]
    crowded = pool[:, width] >= 0
    graph[who[~crowded]] = pool[~crowded, :width]
    if crowded.any():
        graph[who[crowded]] = np.concatenate([robust_prune(v, who[crowded], pool[crowded]), np.full((int(crowded.sum()), width - DEGREE), -1)], axis=1)


def build_graph(v: np.ndarray, first: int = 64) -> np.ndarray:
    """A pruned graph over unit vectors: neighbours' places, -1 for none, up to 2 * DEGREE of them.

    The first points, the medoids among them, are pruned from each other. The others come in batches, half as many as are in
    already at most; each point's pool is what a search from the medoids met. A second round goes over all points, as those
    of a batch don't meet.
    """
    v = v.astype(np.float32)
    m, entry = len(v), medoids(v)
    graph = np.full((m, 2 * DEGREE), -1, dtype=np.int32)
    order = np.random.default_rng(m).permutation(m)
    order = np.concatenate([entry, order[~np.isin(order, entry)]])
    first = max(first, len(entry))

    def insert(of: np.ndarray, pool: np.ndarray) -> None:
        graph[of, :DEGREE] = robust_prune(v, of, pool)
        graph[of, DEGREE:] = -1
        _link_back(v, graph, of)

    start = order[:first]
    insert(start, np.repeat(start[None, :], len(start), axis=0))
    done = len(start)
    while done < m:
        of = order[done : done + min(512, max(32, done // 2))]
        insert(of, greedy_search(v, graph, v[of], entry, POOL, np.zeros((len(of), m), dtype=bool))[0])
        done += len(of)
    for k in range(0, m if m > first else 0, 512):
        of = order[k : k + 512]
        insert(of, np.concatenate([greedy_search(v, graph, v[of], entry, POOL // 2, np.zeros((len(of), m), dtype=bool))[0], graph[of]], axis=1))
    return graph


def range_search(v: np.ndarray, graph: np.ndarray, q: np.ndarray, least: float, entries: np.ndarray | None = None, beam: int = 16, slack: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(query, place): all the pairs that the search finds with a cosine of least or more.

    First a beam search from the medoids, or entries given, then from all that is within slack of the range to their neighbours, until no point
    there has a neighbour not seen. v and q: double precision, in which the pairs are verified.
    """
    m, n, own, asked = len(v), len(q), v.astype(np.float32), q.astype(np.float32)
    seen = np.zeros((n, m), dtype=bool)
    _, _, met = greedy_search(own, graph, asked, medoids(own) if entries is None else entries, min(beam, m), seen)
    rows, places, near = (np.concatenate(x) for x in zip(*met, strict=True))
    keep = near >= least - slack
    hits, frontier = [(rows[keep], places[keep], near[keep])], (rows[keep], places[keep])
    while len(frontier[0]):
        more = []
        for k in range(0, len(frontier[0]), 20_000):
            to = graph[frontier[1][k : k + 20_000]]
            has = to >= 0
            flat = np.repeat(frontier[0][k : k + 20_000], has.sum(axis=1)) * m + to[has]
            flat = np.unique(flat[~seen.ravel()[flat]])
            r, p = np.divmod(flat, m)
            seen[r, p] = True
            near = np.concatenate([np.einsum("ij,ij->i", asked[r[i : i + 200_000]], own[p[i : i + 200_000]]) for i in range(0, len(r), 200_000)] or [np.array([], np.float32)])
            keep = near >= least - slack
            more.append((r[keep], p[keep], near[keep]))
        hits += more
        frontier = tuple(np.concatenate(x) for x in list(zip(*more, strict=True))[:2])
    rows, places, near = (np.concatenate(x) for x in zip(*hits, strict=True))
    rows, places = rows[near >= least - 1e-4], places[near >= least - 1e-4]
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    sure = np.concatenate([np.einsum("ij,ij->i", q[rows[k : k + 200_000]], v[places[k : k + 200_000]]) >= least for k in range(0, len(rows), 200_000)] or [np.array([], bool)])
    return rows[sure], places[sure]


def _adjacency(frame: pd.DataFrame) -> pd.DataFrame:
    """The graph of one part of a shard: a list of ids for each of its points. For each other shard that holds a point, there is a
    list of those of its neighbours that it holds too."""
    graph = build_graph(unit(frame["vector"].tolist()))
    ids, shard, shards = frame["node"].to_numpy(), int(frame["shard"].iloc[0]), _padded(frame["shards"].tolist(), -1)
    source, column = np.nonzero(graph >= 0)
    target = graph[source, column]
    edges = [(np.full(len(source), shard), source, target)]
    for to in shards.T:
        other = (to[source] >= 0) & (to[source] != shard) & (shards[target] == to[source][:, None]).any(axis=1)
        edges.append((to[source[other]], source[other], target[other]))
    to, source, target = (np.concatenate(x) for x in zip(*edges, strict=True))
    order = np.lexsort((source, to))
    to, source, target = to[order], source[order], target[order]
    first = np.flatnonzero((np.diff(to, prepend=-1) != 0) | (np.diff(source, prepend=-1) != 0))
    return pd.DataFrame({"shard": to[first], "node": ids[source[first]], "next": np.split(ids[target], first[1:]) if len(first) else []})


def _padded(lists: list, fill: int) -> np.ndarray:
    """Lists of numbers as rows of one array."""
    lengths = np.array([len(x) for x in lists])
    out = np.full((len(lists), int(lengths.max())), fill)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.concatenate(lists)
    return out


def _links(frame: pd.DataFrame, lists: pd.DataFrame, least: float) -> pd.DataFrame:
    """For the queries of one (shard, graph part, query part), and the lists of its graph: rows (node, root, links). A pair is
    counted in the first of the shards in which either of its points asks for the other; where one of them alone asks there,
    it is counted for both. So is one that either of two points of this part finds, both of which ask here (in a part of up to SQUARE_ROWS
    points; beyond, each counts what it finds itself). links counts the vectors that are linked; root is the smallest node that the links in this part
    lead to. Points without either have no row."""
    frame = frame.sort_values("node", kind="stable").reset_index(drop=True)
    nodes, queries = np.flatnonzero(frame["is_node"].to_numpy(bool)), np.flatnonzero(frame["is_query"].to_numpy(bool))
    if not (len(nodes) and len(queries)):
        return pd.DataFrame({"node": [], "root": [], "links": []}, dtype=np.int64)
    shard, ids, x = int(frame["shard"].iloc[0]), frame["node"].to_numpy(), unit(frame["vector"].tolist())
    real = ids >= FIRST_PROBE + PROBES
    size = np.where(real, frame["size"].to_numpy(), 0)
    shards, asked = _padded(frame["shards"].tolist(), -1), _padded(frame["asked"].tolist(), -2)
    home, asks = (shards == shard).any(axis=1), (asked == shard).any(axis=1)
    root, links = np.arange(len(frame)), np.zeros(len(frame), dtype=np.int64)
    graph = _united(ids[nodes], lists)
    entries = medoids(x[nodes].astype(np.float32))
    none = np.iinfo(np.int64).max
    at, turn = np.full(len(frame), -1), np.zeros(len(frame), dtype=bool)
    at[nodes], turn[queries] = np.arange(len(nodes)), True
    square = np.zeros((len(nodes),) * 2 if len(nodes) <= SQUARE_ROWS else (0, 0), dtype=bool)

    def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, none).min(axis=1)

    for k in range(0, len(queries), 256):
        some = queries[k : k + 256]
        q, h = range_search(x[nodes], graph, x[some], least, entries)
        q, h = some[q], nodes[h]
        other = q != h
        q, h = q[other], h[other]
        for lo in range(0, len(q), 50_000):
            a, b = q[lo : lo + 50_000], h[lo : lo + 50_000]
            mine = np.minimum(first_common(asked[a], shards[b]), first_common(asked[b], shards[a])) == shard
            a, b = a[mine], b[mine]
            here = (at[a] >= 0) & turn[b]
            if len(square):
                square[at[a[here]], at[b[here]]] = True
                a, b = a[~here], b[~here]
            np.add.at(links, a, size[b])
            alone = ~(asks[b] & home[a])
            np.add.at(links, b[alone], size[a[alone]])
        both = real[q] & real[h]
        q, h = q[both], h[both]
        if not len(q):
            continue
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        for s, e in zip(first, np.append(first[1:], len(q)), strict=True):
            met = np.unique(np.append(root[h[s:e]], root[q[s]]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    square |= square.T
    for k in range(0, len(square), 256):
        links[nodes[k : k + 256]] += square[k : k + 256] @ size[nodes]
    keep = (links > 0) | (root != np.arange(len(frame)))
    return pd.DataFrame({"node": ids[keep], "root": ids[root[keep]], "links": links[keep]})


def _united(ids: np.ndarray, lists: pd.DataFrame) -> np.ndarray:
    """The lists (node, next) of these points, ascending, each point's from all its shards as one: places in ids, -1 for none."""
    ends = np.array([len(x) for x in lists["next"]], dtype=np.int64)
    node = np.repeat(lists["node"].to_numpy(np.int64), ends)
    to = np.concatenate([*lists["next"], np.array([], np.int64)]).astype(np.int64)
    row, place = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (node, to))
    inside = (ids[row] == node) & (ids[place] == to)
    row, place = np.divmod(np.unique(row[inside] * len(ids) + place[inside]), len(ids))
    column = np.arange(len(row)) - np.searchsorted(row, row)
    graph = np.full((len(ids), int(column.max(initial=0)) + 1), -1, dtype=np.int32)
    graph[row, column] = place
    return graph


def _dealt(points: DataFrame, centroids: np.ndarray, overlap: int, margin: float) -> DataFrame:
    """(node, size, vector, shards, asked): each point with the numbers of its nearest centroids and of those it asks, ascending."""
    shared = points.sparkSession.sparkContext.broadcast((centroids, grouped(centroids)))
    overlap = min(overlap, len(centroids))

    def deal(frames):
        for frame in frames:
            if len(frame):
                c, groups = shared.value
                homes, asked = homes_and_asked(unit(frame["vector"].tolist()), c, overlap, groups, margin)
                yield frame.assign(shards=list(homes), asked=asked)

    kind = points.schema["vector"].dataType.simpleString()
    return points.mapInPandas(deal, f"node long, size long, vector {kind}, shards array<long>, asked array<long>")


def _by_shard(dealt: DataFrame, waves: int = 1, wave: int = 0) -> DataFrame:
    """dealt, a row for each shard that holds the point (home) or that it asks (asks), of one of some waves of shards. Nothing
    holds points whose size is 0."""
    of = F.array_union("shards", "asked")
    of = F.filter(of, lambda s: _wave(s, waves) == wave) if waves > 1 else of
    each = dealt.select("node", "size", "vector", "shards", "asked", F.explode(of).alias("shard"))
    return each.withColumns({"home": F.array_contains("shards", F.col("shard")) & (F.col("size") > 0), "asks": F.array_contains("asked", F.col("shard"))})


def _wave(key: Column, waves: int) -> Column:
    """The wave in which a key has its turn."""
    return F.pmod(F.xxhash64(key, F.lit(3)), F.lit(waves))


def _waves(rows: int | None, n: int, dim: int) -> int:
    """In how many turns so many rows of vectors are shuffled, so that one moves about WAVE_BYTES, or the vectors of the n points."""
    return max(1, math.ceil((rows or 0) / max(n, WAVE_BYTES / (4 * dim))))


def _dealt_again(dealt: DataFrame, overlap: int, margin: float, shard_rows: int, n: int = 1 << 62, dim: int = 1) -> DataFrame:
    """dealt, with shards of more than 2 * shard_rows points parted by centroids of their own, fitted on a sample of each; a
    point of such a shard goes to several of its parts, and asks those within the margin. Shards are numbered anew, so that parts
    have numbers too. n points of dim numbers tell how much is shuffled at once."""
    kind = dealt.schema["vector"].dataType.simpleString()
    each = _by_shard(dealt)
    large = each.where("home").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_rows)
    large = stored(large.withColumn("k", F.least(F.lit(1024), F.ceil(F.col("n") * overlap / shard_rows))), "vectors-large")
    if large.isEmpty():
        return dealt.withColumns({c: F.transform(c, lambda s: s * 1024) for c in ("shards", "asked")})
    sample = each.where("home").join(F.broadcast(large), "shard")  # MAX_CENTROIDS rows at most
    sample = sample.where(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 30)) < F.least(F.lit(1.0), 8 * F.col("k") / F.col("n")) * (1 << 30))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        c = fit_centroids(unit(frame.sort_values("node")["vector"].tolist()), min(int(frame["k"].iloc[0]), len(frame)))
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "flat": [c.ravel()], "k": [len(c)]})

    fitted = stored(sample.select("shard", "node", "vector", "k").groupBy("shard").applyInPandas(fit, "shard long, flat array<double>, k long"), "vectors-parts")
    # in slices of a bounded number of points, each of which meets its shard's centroids
    slices = F.ceil(F.col("n") / 20_000)
    centroids = fitted.join(F.broadcast(large.select("shard", "n")), "shard").select("shard", "flat", "k", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))

    def deal(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        parts = asked = [[0]] * len(frame)
        if len(frame) and len(own):
            c = np.asarray(own["flat"].iloc[0]).reshape(int(own["k"].iloc[0]), -1)
            parts, asked = homes_and_asked(unit(frame["vector"].tolist()), c, min(overlap, len(c)), grouped(c), margin)
        base = frame["shard"].to_numpy() * 1024
        kept = lambda some, flag: [b + np.asarray(s) if f else [] for b, s, f in zip(base, some, frame[flag], strict=True)]
        return pd.DataFrame({"node": frame["node"], "shard": frame["shard"], "shards": kept(parts, "home"), "asked": kept(asked, "asks")})

    def parted(waves: int, wave: int) -> DataFrame:
        points = _by_shard(dealt, waves, wave).join(F.broadcast(large), "shard")
        points = points.select("shard", F.pmod(F.xxhash64("node"), slices).alias("slice"), "node", "vector", "home", "asks")
        some = centroids.where(_wave(F.col("shard"), waves) == wave)
        return points.groupBy("shard", "slice").cogroup(some.groupBy("shard", "slice")).applyInPandas(deal, "node long, shard long, shards array<long>, asked array<long>")

    waves = _waves(each.select("shard").join(F.broadcast(large), "shard").count(), n, dim)
    again = stored_in(new_folder(dealt.sparkSession, "vectors-again"), (parted(waves, w) for w in range(waves)))
    again = again.groupBy("node").agg(F.collect_set("shard").alias("old"), *[F.flatten(F.collect_list(c)).alias(f"new_{c}") for c in ("shards", "asked")])
    none = F.array().cast("array<long>")

    def anew(c: str) -> Column:
        plain = F.filter(c, lambda s: ~F.array_contains(F.coalesce("old", none), s))
        return F.array_sort(F.concat(F.coalesce(f"new_{c}", none), F.transform(plain, lambda s: s * 1024))).alias(c)

    return dealt.join(again, "node", "left").select("node", "size", F.col("vector").cast(kind).alias("vector"), anew("shards"), anew("asked"))


def _near(v: np.ndarray, least: float) -> np.ndarray:
    """Unit vectors at cosines from least up to nearly 1 from the given ones, in directions drawn at random."""
    if v.shape[1] < 2:
        return v
    away = np.random.default_rng(len(v)).standard_normal(v.shape)
    away = unit(list(away - (away * v).sum(axis=1, keepdims=True) * v))
    cosine = np.linspace(least + 1e-6, 0.5 + least / 2, len(v))[:, None]
    return cosine * v + np.sqrt(1 - cosine**2) * away


def _spread(v: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, or all, spread over them."""
    return v[np.linspace(0, len(v) - 1, min(n, len(v))).astype(int)]


def _probes(sample: pd.DataFrame, least: float) -> np.ndarray:
    """Vectors at cosines from least up to nearly 1 from vectors of the sample, spread over it."""
    return _near(_spread(unit(sample["vector"].tolist()), PROBES), least)


def _needed(x: np.ndarray, y: np.ndarray, c: np.ndarray, overlap: int) -> np.ndarray:
    """The margin by which each of y asks a shard that holds the one of x in its place."""
    out, homes = np.empty(len(x)), nearest_centroids(x, c, min(overlap, len(c)), grouped(c))
    for k in range(0, len(x), step := max(1, (2 << 20) // max(len(c), 16 * x.shape[1]))):
        near = (y[k : k + step].astype(np.float32) @ c.T.astype(np.float32)).astype(np.float64)
        first, rows = near.argmax(axis=1), np.arange(len(near))
        behind = near[rows, first][:, None] - np.take_along_axis(near, homes[k : k + step], axis=1)
        apart = np.sqrt(((c[homes[k : k + step]] - c[first][:, None]) ** 2).sum(axis=2))
        out[k : k + step] = np.where(apart > 1e-9, behind / np.maximum(apart, 1e-9), 0).min(axis=1)
    return out


def fit_margin(x: np.ndarray, c: np.ndarray, overlap: int, least: float, mutual: bool = False) -> float:
    """The least margin with which vectors near x ask a shard that holds what they are near to, in MARGIN_SHARE of all cases;
    mutual: with which either of the two asks one that holds the other.

    At the limit a vector is sqrt(1 - least^2) aside of another: in d dimensions sqrt(d) times less along any one direction, such
    as that between two centroids. It is as far behind, at most, as it is aside."""
    x = _spread(x, MARGIN_ROWS)
    near = _near(x, least)
    needed = _needed(x, near, c, overlap)
    if mutual:
        needed = np.minimum(needed, _needed(near, x, c, overlap))
    return float(np.quantile(needed, MARGIN_SHARE, method="higher")) + 1e-5


def _links_of(points: DataFrame, n: int, dim: int, least: float, overlap: int, shard_rows: int, wider: float = 1.0, dealt_all: Callable[[], None] = lambda: None) -> tuple[DataFrame, DataFrame, float]:
    """(node, links) and (a, b) edges for the points (node, size, vector) of one dimension, and the recall: on probes and, by
    audit, on points. wider: by how much the margin is multiplied. dealt_all is called when points are read no more.

    Vectors lie in the shared folder once, with the shards of each; they are shuffled to these in waves of shards, so that the
    disk holds about what one wave moves, however many shards a point asks."""
    spark, kind = points.sparkSession, points.schema["vector"].dataType
    k = int(np.clip(round(n * overlap / shard_rows), 1, min(MAX_CENTROIDS, SAMPLE_BYTES // (32 * dim))))
    shard_rows = max(shard_rows, min(n * overlap // k, SHARD_BYTES // (8 * dim)))
    share = min(1.0, max(SAMPLE_ROWS, 4 * k) / n, SAMPLE_BYTES / (8 * dim) / n)
    sample = points.where(F.pmod(F.xxhash64("node"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).select("node", "vector").toPandas().sort_values("node")
    if not len(sample):
        sample = points.select("node", "vector").limit(1).toPandas()
    probes = _probes(sample, least)
    # what a point in the points' own precision is found by
    probes = probes if kind.elementType.simpleString() == "double" else probes.astype(np.float32).astype(np.float64)
    rows = [(FIRST_PROBE + k, 1, x) for k, x in enumerate(probes.tolist())]
    own = unit(sample["vector"].tolist())
    centroids = fit_centroids(own, min(k, len(own)))
    once, either = (wider * fit_margin(own, centroids, overlap, least, mutual) for mutual in (False, True))
    first = points.unionByName(spark.createDataFrame(rows, "node long, size long, vector array<double>").withColumn("vector", F.col("vector").cast(kind)))
    folders = {name: new_folder(spark, f"vectors-{name}") for name in ("first", "dealt", "lists", "links")}
    first = stored_in(folders["first"], [_dealt(first, centroids, overlap, either)], PLAIN)
    dealt_all()
    # where one of two points alone asks a shard that is parted, it has to ask the part that holds the other
    again = _dealt_again(first, overlap, once, shard_rows, n, dim)
    waves = _waves(2 * n, n, dim)
    dealt = stored_in(folders["dealt"], (again.where(_wave(F.col("node"), waves) == w) for w in range(waves)), PLAIN)
    removed(spark, folders["first"])
    held, asking = dealt.agg(F.sum(F.size("shards")), F.sum(F.size(F.array_union("shards", "asked")))).first()
    homes = dealt.select("node", F.explode("shards").alias("shard"))
    large = homes.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_rows)
    parts = stored(large.select("shard", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")), "vectors-cut")
    part = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    # as many rows as 2 * shard_rows go into the homes of all points, at most
    cut = lambda rows: rows.join(F.broadcast(parts), "shard", "left").na.fill(1, ["parts"]).withColumn("part", part)
    together = lambda rows: rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def lists_of(waves: int, wave: int) -> DataFrame:
        some = cut(_by_shard(dealt, waves, wave).where("home")).select("shard", "part", "node", "vector", "shards")
        return some.groupBy("shard", "part").applyInPandas(_adjacency, "shard long, node long, next array<long>")

    waves = _waves(held, n, dim)
    lists = stored_in(folders["lists"], (lists_of(waves, w) for w in range(waves)))

    def found_by(waves: int, wave: int) -> DataFrame:
        meet = together(cut(_by_shard(dealt, waves, wave)))
        row = ["node", "size", "vector", "shards", "asked"]
        as_node = meet.where("home").select("shard", F.col("part").alias("g"), F.col("with").alias("p"), *row, F.col("home").alias("is_node"), (F.col("asks") & (F.col("part") == F.col("with"))).alias("is_query"))
        as_query = meet.where("asks and not (home and part = with)").select("shard", F.col("with").alias("g"), F.col("part").alias("p"), *row, F.lit(False).alias("is_node"), F.lit(True).alias("is_query"))
        own = together(cut(lists.where(_wave(F.col("shard"), waves) == wave))).select("shard", F.col("part").alias("g"), F.col("with").alias("p"), "node", "next")
        key = ["shard", "g", "p"]
        return as_node.unionByName(as_query).groupBy(*key).cogroup(own.groupBy(*key)).applyInPandas(lambda f, g: _links(f, g, least), "node long, root long, links long")

    waves = _waves(asking, n, dim)
    found = stored_in(folders["links"], (found_by(waves, w) for w in range(waves)))
    removed(spark, folders["lists"])
    links, last = found.groupBy("node").agg(F.sum("links").alias("links")), FIRST_PROBE + PROBES
    plain = dealt.where(F.col("node") >= last).select("node", "size", "vector")
    met = _found(plain, links.where(F.col("node") < last), np.arange(len(rows)) + FIRST_PROBE, unit(list(probes)), least).agg(F.avg("found")).first()[0]
    links = links.where((F.col("node") >= last) & (F.col("links") > 0))
    reached = min((r for r in (met, _recall(plain, links, n, least)) if r is not None), default=1.0)
    removed(spark, folders["dealt"])
    found = found.where(F.col("node") >= last)
    return links, found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), reached


def _found(points: DataFrame, links: DataFrame, ids: np.ndarray, vectors: np.ndarray | None, least: float) -> DataFrame:
    """(want, found) for those of some vectors that link with points, by brute force over all of these: with how many, and
    which share of that number links (node, links) has."""
    shared = points.sparkSession.sparkContext.broadcast((ids, vectors))

    def count(frames):
        for frame in frames:
            ids, q = shared.value
            total = np.zeros(len(ids), dtype=np.int64)
            step = max(1, (4 << 20) // max(1, len(ids)))
            for k in range(0, len(frame) if len(ids) else 0, step):
                some = frame.iloc[k : k + step]
                linked = (q @ unit(some["vector"].tolist()).T >= least) & (ids[:, None] != some["node"].to_numpy()[None, :])
                total += linked @ some["size"].to_numpy()
            yield pd.DataFrame({"node": ids[total > 0], "want": total[total > 0]})

    want = points.mapInPandas(count, "node long, want long").groupBy("node").agg(F.sum("want").alias("want"))
    return want.join(links, "node", "left").select("want", (F.least("want", F.coalesce("links", F.lit(0))) / F.col("want")).alias("found"))


def _recall(points: DataFrame, links: DataFrame, n: int, least: float) -> float | None:
    """The share of a sample's links, by brute force over all points, that were found: the least of the averages over the vectors
    with few links and over those with many, so that no hot group hides the others. None where no link was met: probes tell then.

    The sample grows until it has AUDIT_LINKS linked vectors, holds AUDIT_MOST or all points: to 8 times its size at most, and to no
    more than about what AUDIT_LINKS takes.
    """
    rows = AUDIT_ROWS
    while True:
        share = min(1.0, rows / n)
        sample = points.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).select("node", "vector").toPandas()
        both = _found(points, links, sample["node"].to_numpy(), unit(sample["vector"].tolist()) if len(sample) else None, least)
        strata = both.groupBy((F.col("want") <= 10).alias("few")).agg(F.count("*").alias("n"), F.avg("found").alias("found")).collect()
        linked = sum(r["n"] for r in strata)
        if linked >= AUDIT_LINKS or rows >= min(n, AUDIT_MOST):
            return min((r["found"] for r in strata), default=None)
        rows = min(AUDIT_MOST, int(rows * min(8, max(1.5, 1.2 * AUDIT_LINKS / max(1, linked)))))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, overlap: int = 2,
    shard_rows: int = SHARD_ROWS, recall: float = 0.98,
) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Vectors link with a cosine of least or more in double precision. n_links: the other vectors linked directly, equal ones
    included; component_id: the smallest id that links reach; kept: that is the vector's own id. Vectors that are null,
    zero, or hold nulls or non-finite numbers link with nothing, nor do vectors of different length or rows without an id
    (whose component is null and which aren't kept). Repeated rows are so many vectors.

    Links are searched for, so that some may be missed: recall is measured on a sample, which grows up to AUDIT_MOST vectors while
    few of them have links, and always on probes, whose links are known to be there however rare they are in the table. Below the
    limit the search is repeated with more overlap and a wider margin, up to three times in all; ValueError if it stays below 0.9.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    double = vectors.schema[vector_col].dataType.simpleString() == "array<double>"
    v = F.col(vector_col).cast("array<double>" if double else "array<float>")
    exact = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & (F.size(exact) > 0) & F.forall(exact, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(exact, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.select("id", "good", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(17), "vector").alias("k2"))
    good, own = rows.where("good").withColumn("dim", F.size("vector")), [F.min("id").alias("node"), F.count("*").alias("size")]
    all_links, all_edges = None, None
    with brief_shuffles(spark):
        keys = stored(good.groupBy("k1", "k2").agg(*own, F.first("dim").alias("dim")), "vectors-keys")
        for dim, n in sorted((d, n) for d, n in keys.groupBy("dim").count().collect()):
            rows_in_shard = max(64, min(shard_rows, SHARD_BYTES // (8 * dim)))
            for more in range(3):
                folder = new_folder(spark, "vectors-points")
                points = good.where(F.col("dim") == dim).groupBy("k1", "k2").agg(*own, F.first("vector").alias("vector")).select("node", "size", "vector")
                points = stored_in(folder, [points], PLAIN)
                links, edges, reached = _links_of(points, n, dim, least, overlap + 2 * more, rows_in_shard, 1.0 + more, lambda f=folder: removed(spark, f))
                if reached >= recall:
                    break
            if reached < 0.9:
                raise ValueError(f"the graph finds only {reached:.3f} of the links")
            all_links = links if all_links is None else all_links.unionByName(links)
            all_edges = edges if all_edges is None else all_edges.unionByName(edges)
        components = None if all_edges is None else connected_components(all_edges)
    if all_links is None:
        out = rows.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("id")})
    else:
        of = keys.join(all_links, "node", "left").join(components, "node", "left")
        of = of.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
        out = rows.where("good").select("id", "k1", "k2").join(of, ["k1", "k2"], "left").select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
        out = out.unionByName(rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
