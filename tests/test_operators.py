import math

import numpy as np
import pytest

from repset.operators import adjust, components, filters, greedy, linkage, pairs, score, segments, sketch, warn
from repset.operators.components import connected_components

# golden distances of five items: two near, one near them, one far, one apart
GOLD = np.array([[0, 0.243761, 0.243761, 0.243761, 1], [0.243761, 0, 0.0157245, 0.00243596, 1], [0.243761, 0.0157245, 0, 0.0154542, 1], [0.243761, 0.00243596, 0.0154542, 0, 1], [1, 1, 1, 1, 0]])


def test_n50_is_strict(spark):
    rows = spark.createDataFrame([(1, 4), (1, 3), (1, 1), (2, 5), (2, 5), (3, 0)], "item int, len long")
    got = {r["item"]: (r["total"], r["n50"]) for r in segments.n50(rows, "item", "len").collect()}
    assert got == {1: (8, 3), 2: (10, 5)}


@pytest.mark.parametrize("most", [0, 500_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "ONE_TASK", most)
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 1), (3, 5)], "src long, dst long")
    assert {(r["node"], r["component"]) for r in connected_components(edges).collect()} == {(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)}
    assert connected_components(edges.where("src > 99")).count() == 0
    order = np.random.default_rng(0).permutation(60)
    path = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(59) if i % 20 != 19], "src long, dst long")
    want = {int(order[i]): int(min(order[i // 20 * 20 : i // 20 * 20 + 20])) for i in range(60)}
    assert {r["node"]: r["component"] for r in connected_components(path).collect()} == want


def test_golden_primary_clusters():
    assert linkage.cut(linkage.tree(GOLD, "average"), 5, 0.1).tolist() == [2, 1, 1, 1, 3]
    heights = linkage.tree(GOLD, "average")[:, 2]
    assert np.allclose(heights, [0.00243596, 0.01558935, 0.243761, 1.0])


@pytest.mark.parametrize("method", ["single", "complete", "average", "weighted"])
def test_single_blocks_equal_whole(method):
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        d = rng.random((n, n))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        whole = linkage.cut(linkage.tree(d, method), n, 0.4)
        comp = list(range(n))
        for i in range(n):
            for j in range(n):
                if d[i, j] <= 0.4:
                    a, b = comp[i], comp[j]
                    comp = [min(a, b) if c in (a, b) else c for c in comp]
        seen = {}
        for c in set(comp):
            at = [i for i in range(n) if comp[i] == c]
            for i, k in zip(at, linkage.cut(linkage.tree(d[np.ix_(at, at)], method), len(at), 0.4)):
                seen[i] = (c, k)
        assert all((whole[i] == whole[j]) == (seen[i] == seen[j]) for i in range(n) for j in range(n))


# places on a line: copies at 0 and 0.3, near ones, one apart; 9 and 10 are a block of their own
LINE = {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.3, 5: 0.3, 6: 0.33, 7: 0.6, 8: 0.62}


def _line(spark):
    rows = [(1, a, b, abs(LINE[a] - LINE[b])) for a in LINE for b in LINE] + [(2, 9, 10, 0.01), (2, 10, 9, 0.01)]
    return spark.createDataFrame(rows, "block long, query long, reference long, dist double")


@pytest.mark.parametrize("method", linkage.METHODS)
def test_large_blocks_equal_whole(spark, method):
    groups = lambda df: {frozenset(g) for g in df.groupBy("block", "cluster").agg({"item": "collect_list"}).toPandas().iloc[:, 2].map(tuple)}
    most = 2 if method in linkage.SPLITS else 5
    for cutoff in (0.0, 0.05, 0.2) if method not in linkage.SPLITS else (0.0, 0.05):
        whole = groups(linkage.cluster_blocks(_line(spark), method, cutoff))
        assert groups(linkage.cluster_blocks(_line(spark), method, cutoff, most)) == whole
    assert groups(linkage.cluster_blocks(_line(spark), "single", 0.4, 2)) == {frozenset(LINE), frozenset((9, 10))}


def _line_of_kinds(spark):
    """``_line`` by one item of each place, and what each stands for."""
    copies = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 4, 4), (1, 4, 5), *((1, i, i) for i in (6, 7, 8)), (2, 9, 9), (2, 10, 10)], "block long, rep long, item long")
    own = spark.createDataFrame([(2, 9, 9, 0.0), (2, 10, 10, 0.0)], "block long, query long, reference long, dist double")
    return _line(spark).where("query NOT IN (2, 3, 5) AND reference NOT IN (2, 3, 5)").union(own), copies


@pytest.mark.parametrize("method", linkage.METHODS)
def test_kinds_cluster_as_all_items(spark, method):
    groups = lambda df: {frozenset(g) for g in df.groupBy("block", "cluster").agg({"item": "collect_list"}).toPandas().iloc[:, 2].map(tuple)}
    p, copies = _line_of_kinds(spark)
    for cutoff in (0.05, 0.5):
        whole = groups(linkage.cluster_blocks(_line(spark), method, cutoff))
        for most in (4, 5000) if method in linkage.SPLITS and cutoff < 0.1 else (5000,):
            assert groups(linkage.unfolded(linkage.cluster_blocks(linkage.weighted(p, copies), method, cutoff, most), copies)) == whole


def test_kinds_are_drawn_as_all_items(spark):
    p, copies = _line_of_kinds(spark)
    rows = lambda df: sorted((r["block"], r["step"], r["left"], r["right"], round(r["height"], 12), r["size"]) for r in df.collect())
    # five rows of the matrix of eight items
    assert rows(linkage.link_table(p, "average", 5, copies)) == rows(linkage.link_table(_line(spark), "average"))
    order = lambda df: sorted(map(tuple, df.select("block", "place", "item").collect()))
    assert order(linkage.leaf_order(p, "average", 5, copies)) == order(linkage.leaf_order(_line(spark), "average"))
    heights = lambda df: sorted((r["block"], round(r["height"], 12)) for r in df.collect())
    assert heights(warn.links(linkage.weighted(p, copies), "average")) == heights(warn.links(_line(spark), "average"))
    at = lambda df: {(r["block"], r["item"]): (round(abs(r["x"]), 6), round(abs(r["y"]), 6)) for r in df.collect()}
    assert at(linkage.unfolded(linkage.scale_blocks(linkage.weighted(p, copies)), copies)) == at(linkage.scale_blocks(_line(spark)))


def test_large_blocks_scaled_and_joined(spark):
    at = lambda most: {(r["block"], r["item"]): (abs(r["x"]), abs(r["y"])) for r in linkage.scale_blocks(_line(spark), most).collect()}
    few, whole = at(5), at(5000)
    assert few.keys() == whole.keys() and all(np.allclose(few[k], whole[k], atol=1e-6) for k in whole)
    for method in linkage.METHODS:
        h = [sorted((r["block"], r["height"]) for r in warn.links(_line(spark), method, most).collect()) for most in (5, 5000)]
        assert len(h[0]) == 8 and np.allclose(h[0], h[1], atol=1e-7)


def test_filters(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    q = spark.createDataFrame([("a", 80.0, 30.0), ("b", 75.0, 25.0), ("c", float("nan"), 0.0)], "item string, completeness double, contamination double")
    assert [r[0] for r in filters.by_quality(items, q, "item").collect()] == ["b"]
    assert sorted(r[0] for r in filters.by_quality(items, q, "item", contamination=0).collect()) == ["a", "b"]
    with pytest.raises(IndexError):
        filters.require_quality(items, q.where("item <> 'a'"), "item")
    with pytest.raises(KeyError):
        filters.require_quality(items, q.drop("completeness"), "item")
    with pytest.raises(ValueError):
        filters.require_unique(items.union(items), "item")


def test_distance_formula(spark):
    rows = spark.createDataFrame([(905 / 1000,), (3 / 1000,), (0.0,)], "j double")
    got = [r[0] for r in rows.select(sketch.distance(rows["j"], 21)).collect()]
    assert np.allclose(got, [0.00243596, 0.243761, 1.0], atol=5e-7)


def test_scores(spark):
    rows = spark.createDataFrame([(100.0, 0.0, 100, 100000, 0.0), (100.0, 0.0, 100, 100000, 50.0), (88.2, 10.0, 100, 100000, 50.0)], "completeness double, contamination double, n50 long, length long, strain_heterogeneity double")
    rows = rows.selectExpr("*", "0.0D AS centrality", "0.0D AS extra")
    w = score.Weights(1, 1, 1, 1, 1, 0)
    assert [round(r[0], 6) for r in rows.select(score.score(w, 0.99)).collect()] == [107.0, 107.0, 90.2]
    assert math.isclose(98.28 + 0.5 * math.log10(774663), 101.22455640669153)


def test_greedy(spark):
    items = spark.createDataFrame([(1, 10, 5), (1, 11, 9), (1, 12, 7), (2, 20, 1)], "block long, item long, length long")
    near = spark.createDataFrame([(1, 10, 11), (1, 11, 10), (1, 10, 12), (1, 12, 10)], "block long, query long, reference long")
    got = {r["item"]: (r["representative"], r["number"], r["is_representative"]) for r in greedy.greedy(items, near).collect()}
    assert got == {11: (11, 1, True), 12: (12, 2, True), 10: (11, 1, False), 20: (20, 1, True)}


def test_reciprocal_and_gate(spark):
    p = spark.createDataFrame([(1, 1, 0.9, 1.0), (1, 2, 0.8, 0.5), (2, 1, 0.6, 0.1), (1, 3, 0.9, 0.9)], "query long, reference long, ani double, coverage double")
    got = {(r[0], r[1]): round(r[2], 6) for r in pairs.reciprocal(p).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.7, (2, 1): 0.7}
    assert [r["ani"] for r in pairs.coverage_gate(p, 0.5).orderBy("query", "reference").collect()] == [0.9, 0.0, 0.9, 0.0]


def test_merged_names_collide(spark):
    m = spark.createDataFrame([("1_1", 7), ("3_2", 7), ("1_2", 8), ("3_1", 8), ("5_1", 9)], "old string, group long")
    assert {r[0]: r[1] for r in adjust.merged_names(m).collect()} == {"1_1": "1.3_1.2#7", "3_2": "1.3_1.2#7", "1_2": "1.3_1.2#8", "3_1": "1.3_1.2#8", "5_1": "5_1"}


def _sketches(spark, seed=3):
    """Equal sketches, near ones, an empty one, and hashes that a third of all items have."""
    import random

    rnd = random.Random(seed)
    some = lambda n: [f"{rnd.getrandbits(60):015x}" for _ in range(n)]
    common, base, rows = some(6), some(40), [(0, []), (1, [])]
    for i in range(2, 90):
        own = base[: 40 - i % 4] + some(i % 4 + 2) if i % 3 == 0 else some(20 + i % 30)
        rows.append((i, sorted({*own, *(common if i % 3 == 1 else [])})))
    rows += [(100 + i, rows[5][1]) for i in range(4)] + [(200 + i, rows[6][1]) for i in range(3)]
    return rows, spark.createDataFrame(rows, "item long, hs array<string>")


def _by_hand(a, b, s):
    u = sorted({*a, *b})[:s]
    return len({*u} & {*a} & {*b}), len(u)


def test_pairs_of_sketches_by_hand(spark, monkeypatch):
    monkeypatch.setattr(sketch, "CHUNK_ITEMS", (7, 20))
    monkeypatch.setattr(sketch, "MET", 50)
    rows, df = _sketches(spark)
    want = {(a, b): _by_hand(x, y, 32) for a, x in rows for b, y in rows if a < b and _by_hand(x, y, 32)[0]}
    got = [(r["item1"], r["item2"], r["shared"], r["size"]) for r in sketch.sketch_pairs(df, "item", 32, 5).collect()]
    assert len(got) == len(want) and {(a, b): (n, m) for a, b, n, m in got} == want
    block = spark.createDataFrame([(i, i % 2) for i, _ in rows], "item long, block long")
    inside = {(r["item1"], r["item2"]): (r["shared"], r["size"]) for r in sketch.compared_within(df, "item", block, 32, 5).collect()}
    assert inside == {k: v for k, v in want.items() if k[0] % 2 == k[1] % 2}


def test_containment_by_hand(spark):
    rows, df = _sketches(spark)
    block = spark.createDataFrame([(i, i % 2) for i, _ in rows if i % 5], "item long, block long")
    got = sketch.containment(df, "item", block, 5).collect()
    want = {(a % 2, a, b): len({*x} & {*y}) for a, x in rows for b, y in rows if a % 5 and b % 5 and a % 2 == b % 2 and {*x} & {*y}}
    assert len(got) == len(want) and {(r["block"], r["query"], r["reference"]): r["shared"] for r in got} == want
    n = {i: len(x) for i, x in rows}
    for r in got:
        assert math.isclose(r["ani"], (r["shared"] / n[r["query"]]) ** 0.2) and math.isclose(r["back"], (r["shared"] / n[r["reference"]]) ** 0.2)


def test_containment_in_chunks(spark, monkeypatch):
    rows, df = _sketches(spark)
    block = spark.createDataFrame([(i, i % 2) for i, _ in rows], "item long, block long")
    want = {(a % 2, a, b): len({*x} & {*y}) for a, x in rows for b, y in rows if a % 2 == b % 2 and {*x} & {*y}}
    monkeypatch.setattr(sketch, "BLOCK_ITEMS", 3)
    got = sketch.containment(df, "item", block, 5).collect()
    assert len(got) == len(want) and {(r["block"], r["query"], r["reference"]): r["shared"] for r in got} == want
    p, copies = sketch.containment_of_kinds(df, "item", block, 5)
    rep = {(r["block"], r["item"]): r["rep"] for r in copies.collect()}
    assert {i for _, i in rep} == {i for i, x in rows if x}
    found = {(r["block"], r["query"], r["reference"]): r["shared"] for r in p.collect()}
    assert found == {k: n for k, n in want.items() if rep[k[0], k[1]] == k[1] and rep[k[0], k[2]] == k[2]}


def test_overlaps_of_common_and_of_rare_hashes(monkeypatch):
    monkeypatch.setattr(sketch, "COLUMNS", 3)
    monkeypatch.setattr(sketch, "MET", 40)
    some = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([some.integers(0, 12, 9), some.integers(100, 160, 6)])) for _ in range(130)]
    for second in (np.full(130, 2), np.arange(130) % 2):
        got = sketch._overlap(7, [(second, np.arange(130)[::-1].copy(), np.array([len(x) for x in sets]), np.concatenate(sets))])
        want = {}
        for i in range(130):
            for j in range(i):
                n = len({*sets[i].tolist()} & {*sets[j].tolist()})
                if n and (second[0] == 2 or second[i] != second[j]):
                    want[129 - i, 129 - j] = (n, len(sets[i]), len(sets[j]))
        assert {(q, r): (n, x, y) for _, q, r, n, x, y in got.T.tolist()} == want


def test_copies_are_linked_and_not_paired(spark):
    """500 copies have 124,750 pairs; their links and what is compared grow with the copies alone."""
    rows, _ = _sketches(spark)
    df = spark.createDataFrame([*((1000 + i, rows[5][1]) for i in range(500)), *rows], "item long, hs array<string>")
    assert sketch.near_links(df, "item", 64, 5, 0.1).where("item1 >= 1000 AND item2 >= 1000").count() <= 499
    assert sketch.near_pairs(df, "item", 64, 5, 0.1).where("item1 >= 1000").count() == 500 * 499 // 2
