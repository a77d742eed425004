"""The k most similar vectors of every vector: score-aware quantisation, four-bit tables, exact reranking.

A sample fits spherical k-means cells and the tables of an anisotropic product quantiser
for the residuals to the cell's centre: 16 entries for each pair of dimensions, so that a
vector is 4 bits a pair. Its loss counts the error parallel to the vector PARALLEL times
as much as the rest, as that part shifts the scores of the vectors that matter. Every
vector is stored in its SPILL nearest cells and asks in the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowstore.llm.vectors import DIM, bytes_matrix, exploded, fixed, packed, runs, unit, usable, whole_groups
from flowstore.plans.tables import cut

K, MIN_COSINE = 5, 0.80
#: Rows of the sample that fits the index, at most; vectors a cell; most cells for each row of the sample.
SAMPLE, CELL, SAMPLE_A_CELL = 65_536, 200, 8
SPILL = 4
#: Rows of a cell that one task compares with as many; larger cells are split, and every pair of the parts compared.
BLOCK = 1 << 16
#: Rows of a cell that are compared with each other; a larger one has cells of its own of about INNER rows, fitted on its rows where it is searched.
WITHIN, INNER = 2_000, 200
#: Deviations of the tables' error within which candidates are reranked; pairs of the sample that it is measured on.
SLACK, MEASURED = 2.5, 20_000
#: Weight of the parallel error, entries of a table (4 bits), rows that fit the tables, rounds of fitting.
PARALLEL, ENTRIES, FIT, ROUNDS = 8.0, 16, 8_192, 3


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k centres of norm 1; a centre without members takes the row that fits its own worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        own, fit = nearest(x, centres, 1)
        sums = np.zeros((k, x.shape[1]))
        order = np.argsort(own[:, 0], kind="stable")
        at = own[order, 0]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sums[at[starts]] = np.add.reduceat(x[order].astype(np.float64), starts)
        size = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(size < 1e-9)
        sums[empty] = x[np.argsort(fit[:, 0], kind="stable")[: len(empty)]]
        centres = (sums / np.linalg.norm(sums, axis=1, keepdims=True)).astype(np.float32)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and scores of the r centres of largest inner product, the best first."""
    r = min(r, len(centres))
    who, score = np.empty((len(x), r), np.int64), np.empty((len(x), r), np.float32)
    for s in range(0, len(x), 2000):
        g = x[s : s + 2000] @ centres.T
        top = np.argpartition(-g, r - 1, axis=1)[:, :r] if r < len(centres) else np.tile(np.arange(r), (len(g), 1))
        order = np.take_along_axis(g, top, 1).argsort(1)[:, ::-1]
        top = np.take_along_axis(top, order, 1)
        who[s : s + 2000], score[s : s + 2000] = top, np.take_along_axis(g, top, 1)
    return who, score


def encode(x: np.ndarray, residual: np.ndarray, tables: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codes by coordinate descent on |e|^2 + (PARALLEL - 1) (x.e)^2, e the error of the residual; x of norm 1.

    tables: (pairs, ENTRIES, 2). The first pass starts from the nearest entries.
    """
    n, pairs = len(x), len(tables)
    xs, rs = (np.ascontiguousarray(a.reshape(n, pairs, 2).transpose(1, 0, 2), np.float32) for a in (x, residual))
    entries = np.ascontiguousarray(tables.transpose(0, 2, 1))
    # of |e|^2 what the entry changes, and x.e, for each pair of dimensions, row and entry
    plain = (tables**2).sum(2)[:, None, :] - 2 * np.matmul(rs, entries)
    along = (xs * rs).sum(2)[:, :, None] - np.matmul(xs, entries)
    codes = plain.argmin(2).T.copy()
    rows = np.arange(n)
    total = sum(along[m][rows, codes[:, m]] for m in range(pairs))
    for _ in range(rounds):
        for m in range(pairs):
            other = total - along[m][rows, codes[:, m]]
            cost = plain[m] + (PARALLEL - 1) * (other[:, None] + along[m]) ** 2
            codes[:, m] = cost.argmin(1)
            total = other + along[m][rows, codes[:, m]]
    return codes.astype(np.uint8)


def decode(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The table entries that the codes stand for, side by side."""
    return tables[np.arange(len(tables)), codes].reshape(len(codes), -1)


def fit_tables(x: np.ndarray, residual: np.ndarray, seed: int = 4) -> np.ndarray:
    """Tables of the anisotropic loss: k-means a pair of dimensions, then codes and least squares in turn."""
    rng = np.random.default_rng(seed)
    n, pairs = len(x), x.shape[1] // 2
    rs = residual.reshape(n, pairs, 2)
    tables = np.zeros((pairs, ENTRIES, 2), np.float32)
    for m in range(pairs):
        c = rs[rng.choice(n, ENTRIES, replace=n < ENTRIES), m].copy()
        for _ in range(6):
            own = ((rs[:, m, None, :] - c) ** 2).sum(2).argmin(1)
            count = np.bincount(own, minlength=ENTRIES)
            mean = np.stack([np.bincount(own, rs[:, m, d], ENTRIES) for d in (0, 1)], 1) / np.maximum(count, 1)[:, None]
            c = np.where(count[:, None] > 0, mean, c)
        tables[m] = c
    width = pairs * ENTRIES * 2
    for _ in range(ROUNDS):
        codes = encode(x, residual, tables)
        place = (np.arange(pairs) * ENTRIES + codes)[:, :, None] * 2 + np.arange(2)  # (n, pairs, 2)
        flat = place.reshape(n, -1)
        w = np.zeros((n, width), np.float32)
        np.put_along_axis(w, flat, x.astype(np.float32), 1)
        a = (PARALLEL - 1) * (w.T @ w).astype(np.float64)
        a[np.arange(width), np.arange(width)] += np.bincount(flat.ravel(), minlength=width) + 1e-3
        b = np.bincount(flat.ravel(), residual.ravel(), width) + (PARALLEL - 1) * w.T @ (x * residual).sum(1) + 1e-3 * tables.ravel()
        tables = np.linalg.solve(a, b).reshape(pairs, ENTRIES, 2).astype(np.float32)
    return tables


def table_error(x: np.ndarray, shown: np.ndarray, cell: np.ndarray, least: float) -> float:
    """The deviation of the tables' scores from the true ones, over pairs of rows of one cell that are
    nearly as similar as neighbours, or else the most similar of those there are.
    """
    order = np.argsort(cell, kind="stable")
    step = 1 + np.random.default_rng(8).integers(0, 8, (len(order), max(1, MEASURED // max(len(order), 1))))
    a = np.repeat(order, step.shape[1])
    b = order[(np.arange(len(order))[:, None] + step).ravel() % len(order)]
    a, b = a[a != b], b[a != b]
    if not len(a):
        return 0.05
    true = np.einsum("ij,ij->i", x[a], x[b])
    error = true - np.einsum("ij,ij->i", x[a], shown[b])
    near = true >= min(least - 0.15, np.sort(true)[-min(len(true), 100)])
    return float(np.sqrt((error[near] ** 2).mean()))


def _index(sample: np.ndarray, n: int, least: float) -> dict:
    k = int(np.clip(n // CELL, 1, max(1, len(sample) // SAMPLE_A_CELL)))
    x = unit(sample).astype(np.float32)
    centres = spherical_kmeans(x, k)
    own, _ = nearest(x, centres, SPILL)
    part = np.random.default_rng(6).permutation(len(x))[:FIT]
    residual = x[part] - centres[own[part, 0]]
    tables = fit_tables(x[part], residual)
    shown = decode(encode(x[part], residual, tables), tables) + centres[own[part, 0]]
    share = np.bincount(own.ravel(), minlength=k) / len(x)
    return {"centres": centres, "tables": tables, "slack": SLACK * table_error(x[part], shown, own[part, 0], least), "parts": np.maximum(1, np.ceil(share * n / BLOCK)).astype(np.int64)}


def _store(index, dim: int):
    """Rows (task, own, other, id, v, codes): a vector in each task that it takes part in. own and other number the parts of the cell."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = index.value
        centres, tables, parts = it["centres"], it["tables"], it["parts"]
        first = np.concatenate([[0], np.cumsum(parts * (parts + 1) // 2)])
        for b in batches:
            if not b.num_rows:
                continue
            ids, raw = b.column(0).to_numpy(), bytes_matrix(b.column(1), 4 * dim).view(np.float32)
            x = unit(raw).astype(np.float32)
            cells, _ = nearest(x, centres, SPILL)
            for j in range(cells.shape[1]):
                cell = cells[:, j]
                codes = np.concatenate([encode(x[s : s + 2000], x[s : s + 2000] - centres[cell[s : s + 2000]], tables) for s in range(0, len(x), 2000)])
                halves = codes[:, 0::2] | (codes[:, 1::2] << 4)
                part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
                for other in range(int(parts[cell].max())):
                    at = np.flatnonzero(parts[cell] > other)
                    lo, hi = np.minimum(part[at], other), np.maximum(part[at], other)
                    task = first[cell[at]] + hi * (hi + 1) // 2 + lo
                    cols = [pa.array(task), pa.array(cell[at]), pa.array(part[at]), pa.array(ids[at]), packed(raw[at]), fixed(halves[at])]
                    yield pa.RecordBatch.from_arrays(cols, ["task", "cell", "part", "id", "v", "codes"])

    return step


def best_within(
    ids: np.ndarray, x: np.ndarray, shown: np.ndarray, part: np.ndarray, k: int, least: float, slack: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, score) of the k best of each row by exact cosine of at least `least`, ties by smaller id.

    x: unit rows in float64; shown: what their codes decode to. The tables' scores of all
    rows are a matrix product with `shown`. What they put within `slack` of the k-th best
    score, or of `least`, is scored again by a product with the vectors themselves, and
    what ties with the k-th best at its precision once more in float64. Rows of two parts
    are only compared across them.
    """
    n = len(ids)
    wide = x.astype(np.float32)
    across = part.min() != part.max()
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    kth = lambda scores: np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -2, np.float32)
    for at in range(0, n, 500):
        rows = np.arange(at, min(at + 500, n))
        table = wide[rows] @ shown.T
        table[np.arange(len(rows)), rows] = -2
        if across:
            table[part[rows][:, None] == part] = -2
        close = table >= np.maximum(kth(table) - 2 * slack, least - slack)[:, None]
        columns = np.flatnonzero(close.any(0))
        if not len(columns):
            continue
        score = np.full(table.shape, -2, np.float32)
        score[:, columns] = np.where(close[:, columns], wide[rows] @ wide[columns].T, -2)
        i, j = np.divmod(np.flatnonzero(score >= np.maximum(kth(score), least)[:, None] - 1e-5), n)
        if not len(i):
            continue
        exact = np.concatenate([np.einsum("ij,ij->i", x[rows[i[c : c + 100_000]]], x[j[c : c + 100_000]]) for c in range(0, len(i), 100_000)])
        exact = np.round(exact, 10)  # equal vectors have equal scores
        keep = (exact >= least) & (ids[rows[i]] != ids[j])
        got.append(_first(ids[rows[i[keep]]], ids[j[keep]], exact[keep], k))
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*got))


def _first(own: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different neighbours of each id, ties by smaller id."""
    order = np.lexsort((other, -score, own))
    own, other, score = own[order], other[order], score[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (other[1:] != other[:-1])] if len(own) else np.empty(0, bool)
    own, other, score = own[new], other[new], score[new]
    first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.empty(0, bool)
    top = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0)) < k
    return own[top], other[top], score[top]


def best_in_cell(
    ids: np.ndarray, x: np.ndarray, shown: np.ndarray, part: np.ndarray, k: int, least: float, slack: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`best_within` of a cell of any size: a large one is divided once, into cells of about INNER rows, and each row compared in its SPILL nearest."""
    n = len(ids)
    if n <= WITHIN:
        return best_within(ids, x, shown, part, k, least, slack)
    wide, cells = x.astype(np.float32), n // INNER
    few = np.random.default_rng(9).permutation(n)[: 32 * cells]
    own, _ = nearest(wide, spherical_kmeans(wide[few], cells, 5), SPILL)
    row = np.tile(np.arange(n), own.shape[1])
    order = np.argsort(own.T.ravel(), kind="stable")
    row = row[order]
    got = []
    for s, e in runs(own.T.ravel()[order]):
        at = row[s:e]
        got.append(best_within(ids[at], x[at], shown[at], part[at], k, least, slack))
    return _first(*(np.concatenate(c) for c in zip(*got)), k)


def _search(index, dim: int, k: int, least: float):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = index.value
        for t in whole_groups(batches, "task", 10_000):
            task = t.column("task").to_numpy()
            cells, parts, ids = (t.column(c).to_numpy() for c in ("cell", "part", "id"))
            raw = bytes_matrix(t.column("v"), 4 * dim).view(np.float32)
            halves = bytes_matrix(t.column("codes"), dim // 4)
            out = []
            for s, e in runs(task):
                if e - s < 2:
                    continue
                codes = np.empty((e - s, dim // 2), np.uint8)
                codes[:, 0::2], codes[:, 1::2] = halves[s:e] & 15, halves[s:e] >> 4
                shown = decode(codes, it["tables"]) + it["centres"][cells[s]]
                out.append(best_in_cell(ids[s:e], unit(raw[s:e]), shown, parts[s:e], k, least, it["slack"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["id", "neighbour", "score"])

    return step


def _raw(dim: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = usable(b, dim)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), packed(raw)], ["id", "v"])

    return step


def nearest_neighbours(sources: list[tuple[DataFrame, str, str]], k: int = K, least: float = MIN_COSINE, dim: int = DIM, sample: int = SAMPLE) -> DataFrame:
    """(id, neighbours: array of (score, id)) of each vector with a neighbour: up to k, the most similar first.

    sources: tables with the names of two parallel array columns, ids and vectors, taken
    as one collection. Neighbours have a cosine of at least `least`; equal scores go to
    the smaller id. Entries with a null id, and vectors that are null, of another length
    than dim, not finite or all zero, are left out; exact copies are neighbours like
    others; a repeated id is never its own neighbour. Empty tables give no rows; other
    columns are ignored.

    The index is fitted on a hash sample of about `sample` vectors, and all are stored in
    it, but for copies beyond the k + 1 of smallest ids, which can be no one's neighbours and
    find what these find. What the driver gets and broadcasts is bounded by `sample`, not by the rows. A
    cell that the sample shows to hold more than BLOCK rows is split, and its parts are
    compared pair by pair in tasks of their own.
    """
    spark = sources[0][0].sparkSession
    every = None
    for df, ids, vectors in sources:
        one = exploded(df, ids, vectors)
        every = one if every is None else every.unionByName(one)
    every = every.mapInArrow(_raw(dim), "id long, v binary")
    kept, crowd = _thinned(every, k)
    n = sum(df.select(F.sum(F.coalesce(F.size(F.col(f"`{ids}`")), F.lit(0)))).first()[0] or 0 for df, ids, _ in sources)
    buckets = 1 << 30
    chosen = kept.where(F.pmod(F.xxhash64("id"), F.lit(buckets)) < int(min(1.0, sample / max(n, 1)) * buckets))
    got = chosen.select("id", "v").toArrow()
    out = "id long, neighbour long, score double"
    if not got.num_rows:
        return spark.createDataFrame([], "id long, neighbours array<struct<score:double,id:long>>")
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    index = spark.sparkContext.broadcast(_index(bytes_matrix(got.column("v"), 4 * dim).view(np.float32)[order], n, least))
    stored = kept.select("id", "v").mapInArrow(_store(index, dim), "task long, cell long, part long, id long, v binary, codes binary")
    found = stored.repartition("task").sortWithinPartitions("task").mapInArrow(_search(index, dim, k, least), out)
    # at most k for each of SPILL cells (and pairs of parts) meet under an id
    merged = found.groupBy("id").agg(F.collect_set(F.struct((-F.col("score")).alias("worse"), "neighbour")).alias("all"))
    best = merged.select("id", F.slice(F.array_sort("all"), 1, k).alias("best"))
    if crowd is not None:
        # what a copy that is not in the index finds is what its first copy finds, and that one
        first = best.withColumnRenamed("id", "first")
        own = F.array(F.struct(F.lit(-1.0).alias("worse"), F.col("first").alias("neighbour")))
        rest = crowd.join(first, "first", "left").select("id", F.slice(F.array_sort(F.concat(own, F.coalesce("best", F.array().cast(best.schema["best"].dataType)))), 1, k).alias("best"))
        best = best.unionByName(rest)
    return best.select("id", F.transform("best", lambda x: F.struct((-x["worse"]).alias("score"), x["neighbour"].alias("id"))).alias("neighbours"))


def _thinned(every: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """(id, v) without copies that no neighbours can be: those beyond the k + 1 smallest ids of equal vectors; and these copies (id, first), or None if there are none.

    Counts are combined before the shuffle, and so are ranks, as only the first ones are kept.
    """
    hashed = every.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})
    many = hashed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > k + 1)
    many = cut(many.select("a", "b", "first"))
    if many.isEmpty():
        return every, None
    copies = cut(hashed.select("id", "a", "b").join(many, ["a", "b"]))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))
    stay = copies.withColumn("r", rank).where(F.col("r") <= k + 1).select("a", "b", "id")
    crowd = cut(copies.join(stay, ["a", "b", "id"], "left_anti").select("id", "first"))
    return every.join(crowd.select("id"), "id", "left_anti"), crowd
