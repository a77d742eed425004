"""Groups of mutually similar vectors: MinHash bands, exact Jaccard, components, medoids.

A vector becomes a set of tokens: for each of T random rotations, which coordinate of the
rotated vector is largest, with its sign. The tokens of one rotation are a bin of a one
permutation MinHash with one element in it, so the signature is the set itself, and the
Jaccard similarity of two sets with a equal tokens is exactly a / (2 T - a).

A band is a few leading tokens and a few of the set. Bands with the same leading tokens meet
in one place, a cell, so that a row travels once for each lead, not once for each band;
buckets are formed, and pairs verified, where the cell is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowstore.llm.components import connected_components
from flowstore.llm.vectors import DIM, bytes_matrix, exploded, fixed, packed, runs, unit, usable, whole_groups
from flowstore.plans.tables import cut, drop_cut

MIN_COSINE = 0.80
#: Tokens of a vector's set, and the equal ones that two similar sets have at least, a Jaccard similarity of
#: 1/14: 99.94 % of pairs with a cosine of 0.80 have them, and one in 10^5 of unrelated ones that share a
#: bucket of three.
TOKENS, LEAST_EQUAL = 60, 8
MIN_JACCARD = LEAST_EQUAL / (2 * TOKENS - LEAST_EQUAL)
#: Equal tokens from which a row seeks no further hub in a bucket, and from which a link needs no exact
#: cosine: pairs with a cosine of 0.80 have 18, of 0.70 11, of 0.90 32, deviations 3 to 4.
NEAR, SURE = 16, 25
#: Share of the pairs with a cosine of MIN_COSINE that leads, bands and Jaccard similarity may miss together;
#: their chance of one equal token in 64 dimensions (0.308 in a simulation; 0.37 at 0.85, 0.47 at 0.9).
MISS, AGREE = 0.005, 0.305
#: Leads if a cell is told by one, two or three tokens: about as few as MISS allows.
LEADS = {1: 18, 2: 70, 3: 240}
#: Vectors in one cell that are linked at once, 68 bytes each; a cell of more is linked in parts.
CELL = 1 << 21
#: Rows that one map task holds before it sends them to their cells.
HELD = 1 << 16
#: Further leads that divide what is left of a cell of many parts, once; the cells that come of it are linked whole.
FURTHER = 16
#: Groups up to so many members are checked in one piece of memory, larger ones in blocks.
DENSE = 3000
#: Components of more members than this are not gathered in one task; vectors broadcast at once when they are checked.
GIANT, CHUNK = 50_000, 20_000


def binomial(n: int, p: float) -> np.ndarray:
    """The chances of 0 to n hits."""
    return np.array([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])


def lead_plan(n: int) -> tuple[int, int]:
    """Tokens that tell a cell, and leads: a cell has half of CELL of n unrelated vectors at most."""
    width = 1
    while width < max(LEADS) and n > CELL / 2 * (2 * DIM) ** width:
        width += 1
    return width, LEADS[width]


def bands_for(rows: int, width: int, leads: int) -> int:
    """Bands of `rows` tokens in a cell, so that MISS of the pairs are missed.

    Bands share the tokens of the set, so the chance is taken for each number of equal
    tokens and averaged over the binomial of it.
    """
    weight = binomial(TOKENS, AGREE)[LEAST_EQUAL:]
    hit = np.array([math.comb(k, rows) / math.comb(TOKENS, rows) for k in range(LEAST_EQUAL, TOKENS + 1)])
    lost, bands = 1 - weight.sum(), 1
    while lost + weight @ (1 - AGREE**width * (1 - (1 - hit) ** bands)) ** leads > MISS:
        bands += 1
    return bands


def band_plans(width: int, leads: int) -> list[tuple[int, int]]:
    """Rows and bands that miss as little, of two to four rows. Made on the driver and sent as plain numbers."""
    return [(rows, bands_for(rows, width, leads)) for rows in (2, 3, 4)]


def band_plan(m: int, plans: list[tuple[int, int]]) -> tuple[int, int]:
    """Rows a band and bands in a cell of m rows: the least work, where forming a bucket costs about as much as comparing a row with an unrelated one."""
    return min(plans, key=lambda p: p[1] * (1 + m / (2 * DIM) ** p[0]))


def band_tokens(rows: int, bands: int, seed: int = 5, tokens: int = TOKENS) -> np.ndarray:
    """The tokens of each band. Permutations of all tokens are cut into bands, so that every token is in as many and few bands overlap."""
    rng, each = np.random.default_rng(seed), tokens // rows
    return np.concatenate([rng.permutation(tokens)[: each * rows].reshape(each, rows) for _ in range(-(-bands // each))])[:bands]


def rotations(tokens: int, dim: int = DIM, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(tokens)], axis=1).astype(np.float32)


def token_sets(v: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """uint8 tokens of unit vectors, one column for each rotation."""
    dim = v.shape[1]
    out = np.empty((len(v), turns.shape[1] // dim), np.uint8)
    for s in range(0, len(v), 250):
        turned = (v[s : s + 250] @ turns).reshape(-1, out.shape[1], dim)
        top = np.abs(turned).argmax(2)
        sign = np.take_along_axis(turned, top[:, :, None], 2)[:, :, 0] > 0
        out[s : s + 250] = top + dim * sign
    return out


def cliques(v: np.ndarray, least: float = MIN_COSINE) -> np.ndarray:
    """For each row of unit vectors the number of its group, or -1 for none.

    Within a group any two rows have a cosine of at least `least`. If all rows do, they
    are one group. Otherwise the row with most neighbours left (the first of equals) is
    the medoid; its neighbours join in order of similarity where they fit all before
    them; the group is taken out and the next medoid is sought.
    """
    n = len(v)
    out = np.full(n, -1)
    if n < 2:
        return out
    if n > DENSE:
        middle = v.mean(0)
        size = np.linalg.norm(middle)
        # two angles to the middle of at most half the limit add up to the limit at most
        if size > 0 and (v @ (middle / size)).min() >= math.sqrt((1 + least) / 2):
            return np.zeros(n, int)
    eps = 1e-12
    near = lambda rows, cols: v[rows] @ v[cols].T >= least - eps
    degree = np.zeros(n, int)
    every = np.arange(n)
    dense = near(every, every) if n <= DENSE else None
    for s in range(0, n, 1000):
        degree[s : s + 1000] = (dense[s : s + 1000] if dense is not None else near(every[s : s + 1000], every)).sum(1) - 1
    if (degree == n - 1).all():
        return np.zeros(n, int)
    left, group = np.ones(n, bool), 0
    row = lambda i: dense[i] if dense is not None else near(np.array([i]), every)[0]
    while True:
        best = int(np.where(left, degree, -1).argmax())
        if not left[best] or degree[best] < 1:
            return out
        fits = row(best) & left
        members = [best]
        fits[best] = False
        for j in np.argsort(-(v @ v[best]), kind="stable"):
            if fits[j]:
                members.append(int(j))
                fits &= row(j)
                fits[j] = False
        if len(members) > 1:
            out[members] = group
            group += 1
        left[members] = False
        for i in members:
            degree -= row(i)


def _tokens(dim: int, more: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = rotations(TOKENS + more, dim)
        for b in batches:
            ids, raw = usable(b, dim)
            if len(ids):
                sets = token_sets(unit(raw).astype(np.float32), turns)
                both = [fixed(np.ascontiguousarray(x)) for x in (sets[:, :TOKENS], sets[:, TOKENS:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *both], ["id", "tokens", "leads"])

    return step


def _mixed(cell: np.ndarray, lead: int, token: np.ndarray) -> np.ndarray:
    """The cell that a further token makes of a cell."""
    x = (cell.view(np.uint64) ^ np.uint64(lead + 1)) * np.uint64(0x9E3779B97F4A7C15) + token.astype(np.uint64)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) & np.uint64((1 << 63) - 1)).view(np.int64)


def _cell_keys(leads: np.ndarray, width: int, cells: np.ndarray | None) -> Iterator[np.ndarray]:
    """The cells of each row, one array for each lead. Rows that come from a divided cell have it in `cells`."""
    if cells is not None:
        for k in range(min(FURTHER, leads.shape[1])):
            yield _mixed(cells, k, leads[:, k])
        return
    for k in range(leads.shape[1] // width):
        key = np.full(len(leads), k, np.int64)
        for t in range(width):
            key = key * 256 + leads[:, k * width + t]
        yield key


def _counted(width: int, more: int, divided: bool):
    """(cell, n): the rows of each cell in a batch."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = b.column(1).to_numpy() if divided else None
                for key in _cell_keys(bytes_matrix(b.column(0), more), width, cells):
                    found, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["cell", "n"])

    return step


def _sent(width: int, more: int, divided: bool, parts: dict[int, int]):
    """(cell, part, parts, ids, tokens): the rows of a map task that go to one cell, as one row of bytes.
    Rows of a cell of several parts are dealt by a hash of their id.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.array(sorted(parts), np.int64)
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= HELD:
                yield from send(pa.Table.from_batches(held).combine_chunks(), many)
                held, n = [], 0
        if n:
            yield from send(pa.Table.from_batches(held).combine_chunks(), many)

    def send(t: pa.Table, many: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, tokens = t.column(0).to_numpy(), bytes_matrix(t.column(1), TOKENS)
        cells = t.column(3).to_numpy() if divided else None
        for key in _cell_keys(bytes_matrix(t.column(2), more), width, cells):
            part, of = np.zeros(len(key), np.int64), np.ones(len(key), np.int64)
            for i in np.flatnonzero(np.isin(key, many)) if len(many) else ():
                of[i] = parts[int(key[i])]
            split = of > 1
            part[split] = _mixed(ids[split], 0, np.zeros(int(split.sum()))) % of[split]
            order = np.lexsort((ids, part, key))
            k, p, own, sets = key[order], part[order], ids[order], tokens[order]
            at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])])
            blob = lambda x, w: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.r_[at, len(k)].astype(np.int32) * np.int32(w)), pa.py_buffer(np.ascontiguousarray(x))])
            for s in range(0, len(at), 4096):
                e = min(s + 4096, len(at))
                columns = [pa.array(k[at[s:e]]), pa.array(p[at[s:e]]), pa.array(of[order][at[s:e]]), blob(own, 8).slice(s, e - s), blob(sets, TOKENS).slice(s, e - s)]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "part", "parts", "ids", "tokens"])

    return step


def find_roots(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The roots of x in a forest whose roots point at themselves; the ways of x are cut short."""
    r = root[x]
    while True:
        up = root[r]
        if (up == r).all():
            root[x] = r
            return r
        r = up


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of each a and b under the smaller root."""
    while len(a):
        ra, rb = find_roots(root, a), find_roots(root, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


def link_cell(ids: np.ndarray, sets: np.ndarray, picks: np.ndarray, least: int = LEAST_EQUAL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees of sure links, other links between trees, and whether a row may still be linked to rows elsewhere.

    Rows come by id. The first are, for each row, the row with the smallest id that sure
    links lead to; the second pairs of rows with `least` equal tokens; the last is whether
    no row before it was near in one of its buckets. A bucket is stars around few hubs: its
    first row is a hub, to which the similar ones are linked; of those that are not near it
    the first is the next hub, so that an unrelated row parts no pair.
    """
    n = len(ids)
    root, taken, loose = np.arange(n), np.zeros(n, np.int32), []
    bits = max(1, (n - 1).bit_length())
    row, mask = np.arange(n, dtype=np.uint64), np.uint64((1 << bits) - 1)
    for pick in picks:
        key = np.zeros(n, np.uint64)
        for t in pick:
            key = key << np.uint64(7) | sets[:, t]
        key = np.sort(key << np.uint64(bits) | row)
        bucket, order = key >> np.uint64(bits), (key & mask).astype(np.int64)
        same = bucket[1:] == bucket[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        bucket, order = bucket[shared], order[shared]
        while len(order):
            first = np.r_[True, bucket[1:] != bucket[:-1]]
            hub = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))][~first]
            order, bucket = order[~first], bucket[~first]
            equal = np.empty(len(order), np.int16)
            for s in range(0, len(order), 1 << 17):
                equal[s : s + (1 << 17)] = (sets[order[s : s + (1 << 17)]] == sets[hub[s : s + (1 << 17)]]).sum(1)
            sure = equal >= SURE
            join_roots(root, order[sure], hub[sure])
            some = ~sure & (equal >= least)
            some[some] = find_roots(root, order[some]) != find_roots(root, hub[some])
            if some.any():
                loose.append(order[some] * n + hub[some])
            near = equal >= NEAR
            taken[order[near]] += 1
            order, bucket = order[~near], bucket[~near]
    root = find_roots(root, np.arange(n))
    pairs = np.sort(np.concatenate(loose)) if loose else np.empty(0, np.int64)
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    pairs = np.stack([pairs // n, pairs % n], 1)
    return root, pairs[root[pairs[:, 0]] != root[pairs[:, 1]]], taken < len(picks)


def _linked(plans: list[tuple[int, int]]):
    """(id, dst, sure, cell): the links of each cell; of a cell in parts also the rows that may be linked to rows of other parts, with the cell and no dst."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, parts = [], None, 1
        rows_of = lambda src, dst, sure, cell: pa.RecordBatch.from_arrays([pa.array(src), dst, pa.array(np.full(len(src), sure)), cell], ["id", "dst", "sure", "cell"])

        def link() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([np.frombuffer(i, np.int64) for i, _ in held])
            sets = np.concatenate([np.frombuffer(s, np.uint8).reshape(-1, TOKENS) for _, s in held])
            order = np.argsort(ids, kind="stable")
            ids, sets = ids[order], sets[order]
            rows, bands = band_plan(len(ids), plans)
            root, loose, open_ = link_cell(ids, sets, band_tokens(rows, bands, at[0] & 0xFFFFFF))
            tied = np.flatnonzero(root != np.arange(len(ids)))
            for src, dst, sure in ((tied, root[tied], True), (loose[:, 0], loose[:, 1], False)):
                if len(src):
                    yield rows_of(ids[src], pa.array(ids[dst]), sure, pa.nulls(len(src), pa.int64()))
            if parts > 1 and open_.any():
                still = ids[open_]
                yield rows_of(still, pa.nulls(len(still), pa.int64()), False, pa.array(np.full(len(still), at[0])))

        for b in batches:
            for cell, part, of, i, s in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (cell, part) != at:
                    if held:
                        yield from link()
                    held, at, parts = [], (cell, part), of
                held.append((i, s))
        if held:
            yield from link()

    return step


def _links(rows: DataFrame, width: int, leads: int, cell: int) -> tuple[DataFrame, list[DataFrame]]:
    """(src, dst, sure) links within all cells of (id, tokens, leads), and the tables that hold them."""
    more, out, held, plans = width * leads, None, [], band_plans(width, leads)
    divided, base = False, rows
    for last in (False, True):
        columns = ["id", "tokens", "leads", "cell"] if divided else ["id", "tokens", "leads"]
        counts = base.select(*columns[2:]).mapInArrow(_counted(width, more, divided), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        # at most leads * rows / cell of them
        parts = {} if last else {r.cell: -(-r.n // cell) for r in counts.where(F.col("n") > cell).collect()}
        sent = base.select(*columns).mapInArrow(_sent(width, more, divided, parts), "cell long, part long, parts long, ids binary, tokens binary")
        found = cut(sent.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_linked(plans), "id long, dst long, sure boolean, cell long"))
        links = found.where("dst is not null").select(F.col("id").alias("src"), "dst", "sure")
        held.append(found)
        out = links if out is None else out.unionByName(links)
        if not parts:
            return out, held
        base, divided = cut(rows.select("id", "tokens", "leads").join(found.where("cell is not null").select("id", "cell").distinct(), "id")), True
        held.append(base)
    return out, held


def _close(dim: int, least: float):
    """The pairs (src, dst) whose vectors have a cosine of at least `least`."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (unit(bytes_matrix(b.column(k), 4 * dim).view(np.float32)) for k in (2, 3))
                keep = pa.array(np.einsum("ij,ij->i", x, y) >= least - 1e-9)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["src", "dst"])

    return step


def _groups(dim: int, least: float):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "component"):
            component, ids = t.column("component").to_numpy(), t.column("id").to_numpy()
            raw = bytes_matrix(t.column("v"), 4 * dim).view(np.float32)
            out = [[], [], [], []]
            for s, e in runs(component):
                order = s + np.argsort(ids[s:e], kind="stable")
                v = unit(raw[order])
                part = cliques(v, least)
                for g in range(part.max() + 1):
                    at = np.flatnonzero(part == g)
                    own = ids[order[at]]
                    middle = v[at].mean(0)
                    out[0].append(own)
                    out[1].append(np.full(len(at), own.min()))
                    out[2].append(np.full(len(at), len(at)))
                    out[3].append(v[at] @ middle / max(np.linalg.norm(middle), 1e-300))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["vec_id", "group_id", "size", "typicality"])

    return step


def similarity_groups(df: DataFrame, ids: str, vectors: str, dim: int = DIM, least: float = MIN_COSINE, giant: int = GIANT, cell: int = CELL) -> DataFrame:
    """(vec_id, group_id, size, typicality) of each vector in a group of at least two.

    ids and vectors are parallel array columns. Any two members of a group have a cosine
    of at least `least`; no vector is in two groups; group_id is the smallest vec_id of
    the group, size its number of members, typicality the cosine to the group's mean
    direction (the most typical members have the highest). Entries with a null id, and
    vectors that are null, of another length than dim, not finite or all zero, are left
    out; exact copies are members like others; a repeated id counts as a vector each time.
    An empty table gives no rows; other columns are ignored.

    Vectors with equal token sets are folded before the bands. Each bucket is stars
    around few hubs, never all pairs, verified by the exact Jaccard similarity of
    the sets, and by the exact cosine where that leaves a doubt. Components of the verified links are split around medoids of
    highest degree, by exact cosine, so that a wrong link costs no wrong group. A cell of more
    than `cell` vectors is linked in parts; the hubs of the parts meet again, divided by a
    further token. Components of more than `giant` members are split over many tasks.
    """
    source = exploded(df, ids, vectors)
    width, leads = lead_plan(source.count())
    sets = cut(source.mapInArrow(_tokens(dim, width * leads), "id long, tokens binary, leads binary"))
    # two hashes of 64 bits stand for the set where copies are folded
    hashed = sets.withColumns({"a": F.xxhash64("tokens"), "b": F.xxhash64(F.lit(1), "tokens")})
    named = hashed.select("id", "a", "b")
    firsts = named.groupBy("a", "b").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    twins = cut(named.join(firsts, ["a", "b"]).where("id <> first"))
    folded = sets if twins.isEmpty() else hashed.join(twins, ["id", "a", "b"], "left_anti")
    carried = source.mapInArrow(_raw(dim), "id long, v binary")
    found, held = _links(folded, width, leads, cell)
    links = cut(found.groupBy("src", "dst").agg(F.max("sure").alias("sure")))
    for table in [*held, sets]:
        drop_cut(table)
    # few pairs of similar vectors, but of unrelated ones more than rows in large tables: they would tie all to one component
    loose = links.where("not sure").select("src", "dst").join(carried.toDF("src", "v").hint("merge"), "src").join(carried.toDF("dst", "w").hint("merge"), "dst")
    close = loose.select("src", "dst", "v", "w").mapInArrow(_close(dim, least), "src long, dst long")
    joined = connected_components(links.where("sure").select("src", "dst").unionByName(close))
    # the other vectors of a token set are where its first is, or with it where it has no links
    placed = twins.join(joined.withColumnRenamed("id", "first"), "first", "left").select("id", F.coalesce("component", "first").alias("component"))
    alone = twins.select(F.col("first").alias("id"), F.col("first").alias("component")).distinct().join(joined, "id", "left_anti")
    member = cut(joined.unionByName(placed).unionByName(alone))
    drop_cut(links)
    drop_cut(twins)
    # merged at any size: the members grow with the vectors
    rows = carried.join(member.hint("merge"), "id").select("component", "id", "v")
    giants = cut(member.groupBy("component").count().where(F.col("count") > giant).select("component"))
    if giants.isEmpty():
        return _in_tasks(rows, dim, least)
    small = _in_tasks(rows.join(giants, "component", "left_anti"), dim, least)
    return small.unionByName(_giant_groups(cut(rows.join(giants, "component", "left_semi")), dim, least, giant))


_OUT = "vec_id long, group_id long, size long, typicality double"


def _in_tasks(rows: DataFrame, dim: int, least: float) -> DataFrame:
    """Groups of components, each in one task."""
    return rows.select("component", "id", "v").repartition("component").sortWithinPartitions("component").mapInArrow(_groups(dim, least), _OUT)


def _sums(dim: int):
    """(component, n, sum of unit vectors) of each batch."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names, own = np.unique(b.column(0).to_numpy(), return_inverse=True)
                sums = np.zeros((len(names), dim))
                np.add.at(sums, own, unit(bytes_matrix(b.column(2), 4 * dim).view(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(own)), fixed(sums.view(np.uint8).reshape(len(names), -1))], ["component", "n", "s"])

    return step


def _total(dim: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "component", 1000):
            names = t.column("component").to_numpy()
            s = bytes_matrix(t.column("s"), 8 * dim).view(np.float64)
            at = [a for a, _ in runs(names)]
            sums = np.add.reduceat(s, at, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), fixed(np.ascontiguousarray(sums).view(np.uint8).reshape(len(at), -1))], ["component", "s"])

    return step


def _cosine_to(dim: int):
    """(component, id, v, c): c the cosine to the sum of the component, in column 3."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = bytes_matrix(b.column(3), 8 * dim).view(np.float64)
            c = np.einsum("ij,ij->i", unit(bytes_matrix(b.column(2), 4 * dim).view(np.float32)), m) / np.maximum(np.linalg.norm(m, axis=1), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(c)], ["component", "id", "v", "c"])

    return step


def _near(data, least: float) -> Iterator:
    """For batches (component, id, v, ...): each batch's columns, the chunk's arrays of one component,
    which rows of the batch are its own, and what is near what.
    """
    names, ids, raw, *more = data
    x = unit(raw) if len(raw) else raw

    def step(b: pa.RecordBatch, dim: int):
        own, v = b.column(0).to_numpy(), unit(bytes_matrix(b.column(2), 4 * dim).view(np.float32))
        for c in np.intersect1d(own, names):
            at, rows = np.flatnonzero(names == c), np.flatnonzero(own == c)
            for s in range(0, len(rows), 1000):
                part = rows[s : s + 1000]
                yield at, part, v[part] @ x[at].T

    return step


def _degrees(data, dim: int, least: float):
    """(id, n): how many rows of the chunk each row is similar to, itself among them."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _near(data.value, least)
        for b in batches:
            if b.num_rows:
                for _, rows, c in near(b, dim):
                    yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(rows)), pa.array((c >= least - 1e-12).sum(1))], ["id", "n"])

    return step


def _best_near(data, dim: int, least: float):
    """(id, n, low): of the rows of the chunk that a row is similar to the greatest n, of equal ones the smallest low."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low = data.value[3:]
        near = _near(data.value, least)
        for b in batches:
            if b.num_rows:
                for at, rows, c in near(b, dim):
                    close = c >= least - 1e-12
                    most = np.where(close, n[at], -1).max(1)
                    least_id = np.where(close & (n[at] == most[:, None]), low[at], np.iinfo(np.int64).max).min(1)
                    some = most >= 0
                    yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(rows[some])), pa.array(most[some]), pa.array(least_id[some])], ["id", "n", "low"])

    return step


def _joined(data, dim: int, least: float):
    """(component, id, v, c): the rows similar to a medoid of the chunk, under its id, with their cosine to it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = data.value[1]
        near = _near(data.value, least)
        for b in batches:
            if b.num_rows:
                for at, rows, c in near(b, dim):
                    i, j = np.nonzero(c >= least - 1e-12)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[j]]), b.column(1).take(pa.array(rows[i])), b.column(2).take(pa.array(rows[i])), pa.array(c[i, j])], ["component", "id", "v", "c"])

    return step


def _in_chunks(rows: DataFrame, chunk_of: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """The results of `make(chunk)` over all rows for every chunk of about CHUNK rows of chunk_of
    (component, id, v and the columns). Each chunk is broadcast, used and dropped.
    """
    spark, out = rows.sparkSession, None
    blocks = max(1, -(-2 * chunk_of.count() // CHUNK))
    for k in range(blocks):
        block = chunk_of.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).select("component", "id", "v", *columns).toArrow().combine_chunks()
        raw = bytes_matrix(block.column("v"), -1).view(np.float32)
        data = spark.sparkContext.broadcast((block.column("component").to_numpy(), block.column("id").to_numpy(), raw, *(block.column(c).to_numpy() for c in columns)))
        part = cut(rows.mapInArrow(make(data), schema))
        data.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def fitting(v: np.ndarray, c: np.ndarray, ids: np.ndarray, least: float) -> np.ndarray:
    """The rows similar to one medoid that join its group: in order of c, their cosine to it, each where it
    fits all before. Those within half the limit's angle fit each other.
    """
    order = np.lexsort((ids, -c))
    cone = math.sqrt((1 + least) / 2)
    core = int((c >= cone).sum())
    kept = order[:core].tolist()
    rest = order[core:]
    if core:
        fits = np.ones(len(rest), bool)
        for s in range(0, core, 4000):
            fits &= (v[rest] @ v[order[s : min(s + 4000, core)]].T >= least - 1e-12).all(1)
        rest = rest[fits]
    late: list[int] = []
    for i in rest.tolist():
        if not late or (v[late] @ v[i] >= least - 1e-12).all():
            late.append(i)
    return np.array(kept + late, np.int64)


def _fitted(dim: int, least: float):
    """(vec_id, group_id, size, typicality) of the groups of medoids whose similar rows are in one task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "component"):
            ids, c = t.column("id").to_numpy(), t.column("c").to_numpy()
            raw = bytes_matrix(t.column("v"), 4 * dim).view(np.float32)
            for s, e in runs(t.column("component").to_numpy()):
                v = unit(raw[s:e])
                at = fitting(v, c[s:e], ids[s:e], least)
                own, middle = ids[s:e][at], v[at].mean(0)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(at), own.min())), pa.array(np.full(len(at), len(at))), pa.array(v[at] @ middle / max(np.linalg.norm(middle), 1e-300))], ["vec_id", "group_id", "size", "typicality"])

    return step


def _fit_all(data, dim: int, least: float):
    """(id, bad): the rows of the chunk that some row of their group in a batch is not similar to."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = data.value[1]
        near = _near(data.value, least)
        for b in batches:
            bad = [ids[at[(c < least - 1e-12).any(0)]] for at, _, c in near(b, dim)] if b.num_rows else []
            if bad:
                bad = np.unique(np.concatenate(bad))
                yield pa.RecordBatch.from_arrays([pa.array(bad)], ["id"])

    return step


def _large_group(rows: DataFrame, dim: int, least: float) -> DataFrame:
    """Groups of medoids with too many similar rows (component, id, v, c) for one task, by the rule of `fitting`.

    The core, within half the limit's angle of the medoid, is not moved; the others are
    checked against it in chunks, and only those that fit all of it meet in one task.
    """
    core = rows.where(F.col("c") >= math.sqrt((1 + least) / 2))
    rest = cut(rows.where(F.col("c") < math.sqrt((1 + least) / 2)))
    bad = _in_chunks(core.select("component", "id", "v"), rest, [], lambda data: _fit_all(data, dim, least), "id long").distinct()
    good = rest.join(bad, "id", "left_anti")
    late = good.select("component", "id", "v", "c").repartition("component").sortWithinPartitions("component").mapInArrow(_fitted(dim, least), _OUT).select(F.col("vec_id").alias("id"))
    kept = cut(core.unionByName(rest.join(late, "id", "left_semi")).select("component", "id", "v"))
    sums = kept.mapInArrow(_sums(dim), "component long, n long, s binary")
    means = sums.select("component", "s").repartition("component").sortWithinPartitions("component").mapInArrow(_total(dim), "component long, s binary")
    named = kept.groupBy("component").agg(F.min("id").alias("group_id"), F.count("*").alias("size"))
    measured = kept.join(means, "component").select("component", "id", "v", "s").mapInArrow(_cosine_to(dim), "component long, id long, v binary, c double")
    return measured.join(named, "component").select(F.col("id").alias("vec_id"), "group_id", "size", F.col("c").alias("typicality"))


def _giant_groups(rows: DataFrame, dim: int, least: float, giant: int) -> DataFrame:
    """Groups of components too large for one task, the same as `cliques` gives.

    A round counts the degree of every row by products of blocks. A row of the highest
    degree (of equal ones the smallest id) among all rows up to two steps from it is a
    medoid before any of these is, whatever is taken out elsewhere, so all such rows are
    medoids at once; what is similar to one is similar to no other. Their groups are taken
    out, and what is left goes into the next round, or into a task where that is enough.
    Each round costs the square of a component's rows, spread over all tasks: that is what
    exact degrees take. Rows without a similar one leave at once.
    """
    out = None
    while True:
        plain = rows.select("component", "id", "v")
        degree = _in_chunks(plain, rows, [], lambda data: _degrees(data, dim, least), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where("n > 1")
        ranked = cut(plain.join(degree, "id").select("component", "id", "v", "n", F.col("id").alias("low")))
        around = ranked
        for _ in range(2):
            best = _in_chunks(ranked.select("component", "id", "v"), around, ["n", "low"], lambda data: _best_near(data, dim, least), "id long, n long, low long")
            best = best.groupBy("id").agg(F.max(F.struct("n", (-F.col("low")).alias("low"))).alias("m")).select("id", "m.n", (-F.col("m.low")).alias("low"))
            around = cut(ranked.select("component", "id", "v").join(best, "id"))
        medoids = around.where("low = id").select("component", "id", "v")
        joined = cut(_in_chunks(ranked.select("component", "id", "v"), medoids, [], lambda data: _joined(data, dim, least), "component long, id long, v binary, c double"))
        sizes = joined.groupBy("component").count()
        small = joined.join(sizes.where(F.col("count") <= giant), "component", "left_semi")
        part = small.select("component", "id", "v", "c").repartition("component").sortWithinPartitions("component").mapInArrow(_fitted(dim, least), _OUT)
        large = joined.join(sizes.where(F.col("count") > giant), "component", "left_semi")
        if not large.isEmpty():
            part = part.unionByName(_large_group(large, dim, least))
        part = cut(part)
        out = part if out is None else out.unionByName(part)
        left = cut(ranked.select("component", "id", "v").join(part.select(F.col("vec_id").alias("id")), "id", "left_anti"))
        sizes = left.groupBy("component").count()
        out = out.unionByName(_in_tasks(left.join(sizes.where(F.col("count") <= giant), "component", "left_semi"), dim, least))
        rows = cut(left.join(sizes.where(F.col("count") > giant), "component", "left_semi"))
        if rows.isEmpty():
            return out


def _raw(dim: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = usable(b, dim)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), packed(raw)], ["id", "v"])

    return step


def describe_groups(members: DataFrame, typical: int = 3) -> DataFrame:
    """(group_id, size, typical): a group's size and its most typical members, the most typical first to six digits, ties by smaller id."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc(F.round("typicality", 6)), "vec_id"))
    top = members.select("group_id", "size", "vec_id", rank.alias("r")).where(F.col("r") <= typical)
    return top.groupBy("group_id").agg(F.first("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id"))), lambda x: x["vec_id"]).alias("typical"))
