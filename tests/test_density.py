"""Density clusters against a spanning tree by Kruskal, and a hierarchy condensed by plain recursion."""

import numpy as np
import pytest

from seamline.operators import density, detectors
from test_dynamic import panel_of


def plain_tree(x, samples):
    """Kruskal's, ties to smaller rows."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, samples - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    of, edges = np.arange(len(x)), []
    for weight, i, j in sorted((w[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        if of[i] != of[j]:
            of[of == of[j]] = of[i]
            edges.append((weight, i, j))
    return edges


def plain_labels(x, least, samples, method):
    edges = plain_tree(x, samples)
    nodes, root_of = {i: ([i], None, 0.0) for i in range(len(x))}, {i: i for i in range(len(x))}  # rows, parts, weight
    for k, (w, i, j) in enumerate(edges):
        a, b = root_of[i], root_of[j]
        new = len(x) + k
        nodes[new] = (nodes[a][0] + nodes[b][0], (a, b), w)
        for p in nodes[new][0]:
            root_of[p] = new

    def grow(node, birth, is_root):
        """(stability of the best choice, chosen sets) of the cluster that begins at node."""
        total, at, inside = 0.0, node, []
        while True:
            rows, kids, w = nodes[at]
            level = 1 / w
            sizes = [len(nodes[k][0]) for k in kids]
            if min(sizes) >= least:
                total += len(rows) * (level - birth)
                inside = [grow(k, level, False) for k in kids]
                break
            if max(sizes) < least:
                total += len(rows) * (level - birth)
                break
            total += min(sizes) * (level - birth)
            at = kids[int(np.argmax(sizes))]
        below = sum(s for s, _ in inside)
        keep = not inside if method == "leaf" else total >= below
        if keep and not is_root:
            return total, [nodes[node][0]]
        return max(total, below), [c for _, sets in inside for c in sets]

    found = grow(max(nodes), 0.0, True)[1]
    labels = np.full(len(x), -1)
    for k, rows in enumerate(sorted(found, key=min)):
        labels[rows] = k
    return labels


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.normal((0, 0), 0.4, (50, 2)), rng.normal((4, 1), 0.7, (50, 2)), rng.normal((4, -3), 0.2, (30, 2)), rng.uniform(-8, 12, (25, 2))])
    return {"a": a, "far": np.concatenate([rng.normal(0, 0.1, (45, 2)), rng.normal(500, 0.1, (45, 2)), rng.normal(-900, 0.1, (45, 2))]), "tiny": rng.normal(size=(3, 2))}


def test_tree_and_hierarchy_are_the_plain_ones(spark, series):
    """Lists of three neighbours, blocks of 24 rows and bands of 40 edges, so that components search the blocks within reach."""
    space = density.Space(panel_of(spark, series, ("p", "q")), ["p", "q"], 24)
    tree = density.written(density.spanning_tree(space, 4, 3), "tree")
    for name, x in series.items():
        if name != "tiny":
            assert np.allclose(sorted(r["w"] for r in tree.where(f"series = '{name}'").collect()), [w for w, _, _ in plain_tree(x, 4)])
    clusters, rows = density.condensed(space, density.merges(space, tree, 40), 6)
    at = {r["id"]: (r["series"], r["t"]) for r in space.points.collect()}
    assert sorted(at[r["id"]] for r in rows.collect()) == sorted(k for k in at.values() if k[0] != "tiny")
    for method in ("eom", "leaf"):
        got = {}
        for r in rows.join(density.chosen(clusters, method), "c").where("pick is not null").collect():
            name, t = at[r["id"]]
            got.setdefault(name, {}).setdefault(r["pick"], set()).add(t)
        for name in ("a", "far"):
            labels = plain_labels(series[name], 6, 4, method)
            assert len(set(labels)) > 2
            assert sorted(map(sorted, got[name].values())) == sorted(np.flatnonzero(labels == c).tolist() for c in set(labels) - {-1})


def test_copies_noise_and_empty_tables(spark):
    rows = [("s", t, float(t % 2 * 10), 1.0) for t in range(60)] + [("s", 60, None, 1.0), ("s", 61, float("nan"), 1.0)] + [("few", t, float(t), 0.0) for t in range(3)]
    panel = spark.createDataFrame(rows, "series string, t int, p double, q double")
    got = {(r["series"], r["t"]): r["label"] for r in detectors.detect(panel, "hdbscan", ["p", "q"]).collect()}
    assert got == {("s", t): t % 2 for t in range(60)} | {("few", t): -1 for t in range(3)}
    far = {(r["t"], r["cluster"]): r["distance"] for r in density.density_distances(panel, ["p", "q"]).collect()}
    assert far == {(t, c): pytest.approx(0 if t % 2 == c else 10) for t in range(60) for c in (0, 1)}
    assert density.density_clusters(panel.where("false"), ["p", "q"]).count() == 0
    with pytest.raises(ValueError, match="two rows"):
        density.density_clusters(panel, ["p", "q"], 1)
