import numpy as np
import pytest
from pyspark.sql import functions as F

from flowstore.llm import clusters, neighbours
from flowstore.llm.components import connected_components
from flowstore.llm.vectors import unit, whole_groups

DIM = 64


def planted(seed=0, sizes=(2, 3, 5, 9, 40), noise=150, spread=0.02):
    """Unit vectors with tight groups, and the group of each (-1: none)."""
    rng = np.random.default_rng(seed)
    out, group = [], []
    for g, n in enumerate(sizes):
        c = rng.normal(size=DIM)
        for _ in range(n):
            out.append(c / np.linalg.norm(c) + rng.normal(size=DIM) * spread)
            group.append(g)
    out += list(rng.normal(size=(noise, DIM)))
    group += [-1] * noise
    order = rng.permutation(len(out))
    scale = rng.uniform(0.01, 50, len(out))[:, None]
    return (np.array(out) * scale)[order].astype(np.float32), np.array(group)[order]


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [([int(i)], [None if v is None else [float(x) for x in v]]) for i, v in zip(ids, vectors)]
    # columns with clashing names beside the two that count
    return spark.createDataFrame(rows, "ids array<long>, vs array<array<float>>").selectExpr("ids", "vs", "1 as id", "'x' as v", "0 as component")


def test_groups_are_the_planted_ones(spark):
    v, g = planted()
    got = {r.vec_id: (r.group_id, r["size"]) for r in clusters.similarity_groups(table(spark, v), "ids", "vs").collect()}
    want = {i: (int(np.flatnonzero(g == k).min()), int((g == k).sum())) for i, k in enumerate(g) if k >= 0}
    assert got == want


def test_groups_of_copies_unusable_and_repeated(spark):
    v, _ = planted(1, (3,), 20)
    bad = [None, [0.0] * DIM, [1.0] * 3, [float("nan")] * DIM, [float("inf")] + [1.0] * 63]
    rows = [*v, *bad, *([v[0]] * 50)]
    df = table(spark, rows)
    got = clusters.similarity_groups(df, "ids", "vs")
    sizes = sorted(r["size"] for r in clusters.describe_groups(got).collect())
    assert sizes in ([3, 51], [53])
    assert got.where(F.col("vec_id").between(len(v), len(v) + len(bad) - 1)).count() == 0
    assert clusters.similarity_groups(df.limit(0), "ids", "vs").count() == 0
    nulls = spark.sql("select cast(null as array<long>) as ids, cast(null as array<array<float>>) as vs union all select array(1L, null), array(array(1.0f), null)")
    assert clusters.similarity_groups(nulls, "ids", "vs").count() == 0


@pytest.mark.parametrize(("chunk", "giant"), [(40, 60), (20_000, 20)])
def test_giant_components_have_the_same_groups(spark, monkeypatch, chunk, giant):
    """A loose chain, a group with rows outside of its cone, and planted groups: split over tasks they come out as in one."""
    monkeypatch.setattr(clusters, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    v, _ = planted(3, (2, 60, 90), 30)
    turn = np.cumsum(rng.uniform(0.02, 0.2, 180))
    chain = np.zeros((180, DIM))
    chain[np.arange(180), (turn // (np.pi / 2)).astype(int)] = np.cos(turn % (np.pi / 2))
    chain[np.arange(180), (turn // (np.pi / 2)).astype(int) + 1] = np.sin(turn % (np.pi / 2))
    wide = np.eye(DIM)[50] + 0.45 * unit(rng.normal(size=(80, DIM)))
    rows = np.concatenate([v, chain, chain[:3], wide]).astype(np.float32)
    get = lambda **how: {r.vec_id: (r.group_id, r["size"], round(r.typicality, 9)) for r in clusters.similarity_groups(table(spark, rows), "ids", "vs", **how).collect()}
    got, exact = get(giant=giant), get()
    assert got == exact and len(got) > 350


def test_typical_members_and_ties(spark):
    e = np.eye(DIM)[0]
    t = np.array([e, e, e + 0.2 * np.eye(DIM)[1]])
    got = clusters.describe_groups(clusters.similarity_groups(table(spark, t), "ids", "vs"), 2).first()
    assert (got.group_id, got["size"], got.typical) == (0, 3, [0, 1])


def test_cliques_split_a_chain_around_medoids():
    angle = lambda a: np.r_[np.cos(a), np.sin(a), np.zeros(DIM - 2)]
    chain = np.array([angle(x) for x in (0.0, 0.5, 1.0, 1.5, 2.0)])  # neighbours have a cosine of 0.88, others less than 0.8
    part = clusters.cliques(chain)
    for g in range(part.max() + 1):
        m = chain[part == g]
        assert len(m) >= 2 and (m @ m.T >= 0.8).all()
    assert (part >= 0).sum() == 4


@pytest.mark.parametrize("n", [40, clusters.DENSE + 50])
def test_cliques_in_pieces_and_in_blocks_agree(n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(2, DIM))
    v = unit(np.concatenate([a + rng.normal(size=(n - 7, DIM)) * 0.1, b + rng.normal(size=(7, DIM)) * 0.1]))
    part = clusters.cliques(v)
    assert sorted(np.bincount(part)) == [7, n - 7]


def test_plans_follow_the_rows():
    assert clusters.lead_plan(1000) == clusters.lead_plan(10**8) == (1, 18)
    assert clusters.lead_plan(10**9)[0] == 2 and clusters.lead_plan(10**12)[0] == 3
    assert [clusters.band_plan(m, clusters.band_plans(1, 18))[0] for m in (10, 2000, 500_000)] == [2, 2, 3]
    picks = clusters.band_tokens(3, 163)
    assert picks.shape == (163, 3) and np.bincount(picks.ravel(), minlength=clusters.TOKENS).min() >= 7
    # as many leads of wider cells, and bands of any rows, miss no more
    for width, leads in clusters.LEADS.items():
        for rows in (2, 3, 4):
            assert clusters.bands_for(rows, width, leads) < 3000


def pairs_at(cosine, n=4000):
    rng = np.random.default_rng(9)
    a, z = unit(rng.normal(size=(n, DIM))), rng.normal(size=(n, DIM))
    return a, cosine * a + np.sqrt(1 - cosine**2) * unit(z - (z * a).sum(1, keepdims=True) * a)


@pytest.mark.parametrize("m, width, cosine", [(2000, 1, 0.80), (2000, 1, 0.85), (10**6, 1, 0.80), (10**6, 2, 0.80), (10**6, 2, 0.85)])
def test_plans_miss_few_pairs_at_the_threshold(m, width, cosine):
    a, b = pairs_at(cosine)
    leads, t = clusters.LEADS[width], clusters.TOKENS
    turns, plan = clusters.rotations(t + width * leads), clusters.band_plan(m, clusters.band_plans(width, leads))
    equal = clusters.token_sets(a.astype(np.float32), turns) == clusters.token_sets(b.astype(np.float32), turns)
    hit = np.zeros(len(a), bool)
    for k in range(leads):
        one = np.zeros(len(a), bool)
        for pick in clusters.band_tokens(*plan, seed=k):
            one |= equal[:, pick].all(1)
        hit |= one & equal[:, t + k * width : t + (k + 1) * width].all(1)
    same = equal[:, :t].sum(1)
    hit &= same / (2 * t - same) >= clusters.MIN_JACCARD
    assert hit.mean() > 0.992  # 0.995, and three deviations


def test_pairs_at_the_threshold_come_together(spark):
    """The whole operator on isolated pairs at a cosine just over the least, beside as many unrelated vectors; cells of 200 are linked in parts."""
    a, b = pairs_at(0.803, 700)
    v = np.concatenate([a, b]).astype(np.float32)
    for cell in (clusters.CELL, 20):
        got = clusters.similarity_groups(table(spark, v), "ids", "vs", cell=cell).collect()
        pairs = {frozenset(r.vec_id for r in got if r.group_id == g) for g in {r.group_id for r in got}}
        assert sum(frozenset((i, i + 700)) in pairs for i in range(700)) >= 0.98 * 700


def test_a_cell_in_parts_keeps_a_dense_mass_whole(spark):
    v, g = planted(8, (400, 60, 3), 200, 0.03)
    want = {r.vec_id: r.group_id for r in clusters.similarity_groups(table(spark, v), "ids", "vs").collect()}
    got = {r.vec_id: r.group_id for r in clusters.similarity_groups(table(spark, v), "ids", "vs", cell=50).collect()}
    assert got == want and len(got) == 463


def test_an_unrelated_vector_in_a_bucket_parts_no_pair():
    sets = np.zeros((5, clusters.TOKENS), np.uint8)
    sets[1:, 2:] = 1  # all share one bucket; rows 1, 3 and rows 2, 4 are pairs, row 0 is alone
    sets[[2, 4], 2:] = 2
    root, loose, open_ = clusters.link_cell(np.arange(5) * 10, sets, np.array([[0, 1]]))
    assert root.tolist() == [0, 1, 2, 1, 2] and open_.tolist() == [True, True, True, False, False] and not len(loose)
    sets[3, 12:] = 9  # as many as NEAR and SURE do not have in common
    root, loose, open_ = clusters.link_cell(np.arange(5) * 10, sets, np.array([[0, 1]]))
    assert root.tolist() == [0, 1, 2, 3, 2] and loose.tolist() == [[3, 1]] and open_[3]


def test_roots_of_a_long_way_are_joined():
    root = np.arange(500)
    clusters.join_roots(root, np.arange(1, 500), np.arange(499))
    assert (clusters.find_roots(root, np.arange(500)) == 0).all()


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 420)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.id: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def brute_neighbours(v, ids, k=5):
    x = unit(v)
    s = np.round(x @ x.T, 10)
    out = {}
    for i in range(len(x)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(x)) if j != i and s[i, j] >= 0.8)[:k]
        if near:
            out[ids[i]] = [b for _, b in near]
    return out


def test_neighbours_against_brute_force(spark):
    v, _ = planted(5, (2, 3, 6, 30, 80), 300, 0.05)
    v[10] = v[11]  # a copy
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(v))]
    half = len(v) // 2
    sources = [(table(spark, v[:half], ids[:half]), "ids", "vs"), (table(spark, v[half:], ids[half:]), "ids", "vs")]
    got = {r.id: [n.id for n in r.neighbours] for r in neighbours.nearest_neighbours(sources).collect()}
    want = brute_neighbours(v, ids)
    hits = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items())
    assert hits >= 0.99 * sum(map(len, want.values()))
    assert all(len(n) <= 5 for n in got.values())


def test_neighbours_ties_copies_and_empty(spark):
    v = np.tile(np.eye(DIM)[:1], (9, 1)).astype(np.float32)
    got = {r.id: [n.id for n in r.neighbours] for r in neighbours.nearest_neighbours([(table(spark, v), "ids", "vs")]).collect()}
    assert got[0] == [1, 2, 3, 4, 5] and got[8] == [0, 1, 2, 3, 4] and got[2] == [0, 1, 3, 4, 5]
    assert neighbours.nearest_neighbours([(table(spark, v).limit(0), "ids", "vs")]).count() == 0
    assert neighbours.nearest_neighbours([(table(spark, [None, [0.0] * DIM]), "ids", "vs")]).count() == 0


def test_large_cells_are_split_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    v, _ = planted(6, (150,), 60, 0.05)
    ids = list(range(len(v)))
    got = {r.id: [n.id for n in r.neighbours] for r in neighbours.nearest_neighbours([(table(spark, v), "ids", "vs")]).collect()}
    want = brute_neighbours(v, ids)
    hits = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items())
    assert hits >= 0.98 * sum(map(len, want.values()))


def test_large_cells_are_divided_where_they_are_searched(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WITHIN", 150)
    monkeypatch.setattr(neighbours, "INNER", 15)
    monkeypatch.setattr(neighbours, "CELL", 5000)
    v, _ = planted(7, (150, 20, 9, 2), 400, 0.05)
    ids = list(range(len(v)))
    got = {r.id: [n.id for n in r.neighbours] for r in neighbours.nearest_neighbours([(table(spark, v), "ids", "vs")]).collect()}
    want = brute_neighbours(v, ids)
    assert sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items()) >= 0.97 * sum(map(len, want.values()))


def test_many_copies_find_what_few_would(spark):
    v, _ = planted(9, (6, 3), 60, 0.03)
    rows = np.concatenate([v, np.tile(v[:1], (40, 1)), np.tile(v[1:2], (7, 1))]).astype(np.float32)
    ids = [int(i) for i in np.random.default_rng(4).permutation(len(rows))]
    kept, crowd = neighbours._thinned(spark.createDataFrame([(i, bytes(x.tobytes())) for i, x in zip(ids, rows)], "id long, v binary"), 5)
    assert kept.count() == len(v) - 2 + 6 + 6 and crowd.count() == 35 + 2
    got = {r.id: [n.id for n in r.neighbours] for r in neighbours.nearest_neighbours([(table(spark, rows, ids), "ids", "vs")]).collect()}
    assert got == brute_neighbours(rows, ids)


def test_anisotropic_codes_favour_the_parallel_part():
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(2000, DIM))).astype(np.float32)
    tables = neighbours.fit_tables(x, x)
    e = x - neighbours.decode(neighbours.encode(x, x, tables), tables)
    along = np.einsum("ij,ij->i", e, x)
    assert (e**2).sum(1).mean() < 0.25
    assert (along**2).mean() < (e**2).sum(1).mean() / DIM  # less than its share of one dimension


def test_whole_groups_keep_runs_together():
    import pyarrow as pa

    keys = np.repeat([1, 2, 3, 4], [5, 700, 1, 20])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[s : s + 50])], ["k"]) for s in range(0, len(keys), 50)]
    parts = [t.column("k").to_numpy() for t in whole_groups(iter(batches), "k", 60)]
    assert np.array_equal(np.concatenate(parts), keys)
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
