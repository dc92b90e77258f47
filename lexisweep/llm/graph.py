"""A robust-pruned directed graph over vectors, and beam search in it.

Nearness is the largest inner product.  Vectors of a graph get one more component
that makes their lengths equal, queries a zero there, so that nearness by distance
is nearness by inner product.  All steps work on many points at a time.
"""

import numpy

# Edges of a node, beam width while building, and the two rounds' relaxations.
DEGREE = 32
BUILD_BEAM = 64
RELAX = (1.0, 1.2)

# Points of one step, and nodes that each of them expands at once.
TOGETHER = 256
WIDTH = 4


def even_lengths(vectors):
    """``vectors`` with the component that makes them as long as the longest."""
    squares = (vectors * vectors).sum(axis=1)
    more = numpy.sqrt(numpy.maximum(squares.max(initial=0.0) - squares, 0))
    return numpy.concatenate([vectors, more[:, None]], axis=1).astype(numpy.float32)


def beam_search(points, edges, entry, queries, beam, width=WIDTH):
    """(nodes, distances) of at most ``beam`` nearest found for each query, nearest
    first; -1 and infinity where there are fewer.  ``edges`` has -1 for none."""
    n, count = len(points), len(queries)
    squares = (points * points).sum(axis=1)
    nodes = numpy.full((count, beam), -1)
    distances = numpy.full((count, beam), numpy.inf, dtype=numpy.float32)
    done = numpy.ones((count, beam), dtype=bool)
    seen = numpy.zeros((count, n), dtype=bool)
    nodes[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    distances[:, 0] = squares[entry] - 2 * (queries @ points[entry])
    active = numpy.arange(count)
    while len(active):
        best = numpy.argsort(done[active], axis=1, kind="stable")[:, :width]
        rows = active[:, None]
        open_ = ~done[rows, best]
        done[rows, best] = True
        found = edges[numpy.where(open_, nodes[rows, best], 0)]
        found = numpy.where(open_[:, :, None], found, -1).reshape(len(active), -1)
        found.sort(axis=1)
        new = found >= 0
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        new &= ~seen[rows, found]
        at, column = numpy.nonzero(new)
        ids = found[at, column]
        seen[active[at], ids] = True
        values = numpy.full(found.shape, numpy.inf, dtype=numpy.float32)
        values[at, column] = squares[ids] - 2 * numpy.einsum(
            "ij,ij->i", points[ids], queries[active[at]]
        )
        all_values = numpy.concatenate([distances[active], values], axis=1)
        order = numpy.argsort(all_values, axis=1, kind="stable")[:, :beam]
        pick = lambda old, more: numpy.take_along_axis(
            numpy.concatenate([old, more], axis=1), order, axis=1
        )
        nodes[active] = pick(nodes[active], numpy.where(new, found, -1))
        done[active] = pick(done[active], ~new)
        distances[active] = numpy.take_along_axis(all_values, order, axis=1)
        active = active[~done[active].all(axis=1)]
    return nodes, distances


def robust_prune(points, centres, candidates, relax, degree=DEGREE):
    """Rows of at most ``degree`` of ``candidates`` (-1: none) for each centre: the
    nearest first, each dropping those that it is ``relax`` times nearer to."""
    candidates = numpy.sort(candidates, axis=1)
    bad = (candidates < 0) | (candidates == centres[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    vectors = points[numpy.where(bad, 0, candidates)]
    own = points[centres]
    to_centre = ((vectors - own[:, None, :]) ** 2).sum(axis=2)
    squares = (vectors * vectors).sum(axis=2)
    between = (
        squares[:, :, None] + squares[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    )
    left = numpy.where(bad, numpy.inf, to_centre)
    chosen = numpy.full((len(centres), degree), -1)
    rows = numpy.arange(len(centres))
    for k in range(degree):
        best = left.argmin(axis=1)
        ok = numpy.isfinite(left[rows, best])
        if not ok.any():
            break
        chosen[ok, k] = candidates[rows, best][ok]
        # Distances are squared, so the relaxation is, too.
        dropped = relax * relax * between[rows, best] <= to_centre
        left[dropped & ok[:, None]] = numpy.inf
        left[rows, best] = numpy.inf
    return chosen


def build(vectors, degree=DEGREE, beam=BUILD_BEAM, seed=11):
    """(edges, entry) over ``vectors`` (at least one row)."""
    points, n = even_lengths(vectors), len(vectors)
    random = numpy.random.default_rng(seed)
    room = 2 * degree
    edges = numpy.full((n, room), -1)
    start = min(degree, n - 1)
    if start:
        # Random first edges; a step that is not zero avoids the node itself.
        edges[:, :start] = (numpy.arange(n)[:, None] + random.integers(1, n, (n, start))) % n
    middle = points.mean(axis=0)
    entry = int(((points - middle) ** 2).sum(axis=1).argmin())
    for relax in RELAX:
        order = random.permutation(n)
        for low in range(0, n, TOGETHER):
            batch = order[low : low + TOGETHER]
            near, _ = beam_search(points, edges, entry, points[batch], beam)
            pool = numpy.concatenate([near, edges[batch]], axis=1)
            chosen = robust_prune(points, batch, pool, relax, degree)
            edges[batch] = -1
            edges[batch, :degree] = chosen
            _add_back(points, edges, batch, chosen, relax, degree)
    full = numpy.flatnonzero((edges[:, degree:] >= 0).any(axis=1))
    for low in range(0, len(full), TOGETHER):
        part = full[low : low + TOGETHER]
        kept = robust_prune(points, part, edges[part], RELAX[-1], degree)
        edges[part] = -1
        edges[part, :degree] = kept
    return edges[:, :degree], entry


def _add_back(points, edges, batch, chosen, relax, degree):
    """Edges from the chosen to the points that chose them; full nodes are pruned."""
    at, column = numpy.nonzero(chosen >= 0)
    to, source = chosen[at, column], batch[at]
    order = numpy.lexsort((source, to))
    to, source = to[order], source[order]
    nodes, starts, counts = numpy.unique(to, return_index=True, return_counts=True)
    place = numpy.arange(len(to)) - numpy.repeat(starts, counts)
    more = numpy.full((len(nodes), counts.max(initial=0)), -1)
    more[numpy.repeat(numpy.arange(len(nodes)), counts), place] = source
    room = edges.shape[1]
    for low in range(0, len(nodes), TOGETHER):
        part = nodes[low : low + TOGETHER]
        pool = numpy.sort(numpy.concatenate([edges[part], more[low : low + TOGETHER]], axis=1), axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        pool = -numpy.sort(-pool, axis=1)
        many = (pool >= 0).sum(axis=1) > room
        edges[part[~many]] = _fitted(pool[~many], room)
        if many.any():
            kept = robust_prune(points, part[many], pool[many], relax, degree)
            edges[part[many]] = _fitted(kept, room)


def _fitted(rows, room):
    if rows.shape[1] >= room:
        return rows[:, :room]
    return numpy.pad(rows, ((0, 0), (0, room - rows.shape[1])), constant_values=-1)
