"""Grouping records into clusters of mutually similar ones.

Records become vectors of hashed weighted features. Distributed k-means with parallel oversampled
seeding divides the space: each seeding round takes, in one pass, the points with the greatest
weighted-sampling keys by their squared distance to the seeds so far; the candidates, weighted by
the points nearest to them, are reduced to k seeds; a few Lloyd passes follow. Only seeds and sums
per centroid, whose number is a parameter, come to the driver.

Clusters (:func:`tight`) are then found within the k-means cells. A cell is taken with a halo of
four times the radius, so all that is linked to a set of diameter ``radius`` lies in the cell of each
of the set's members: what a cell proves a cluster is a whole component of all points.
Within a cell the points are reduced to a grid of the radius' width, with the extent of each grid
cell in fixed directions: its size depends on the space, not on the number of points. Linked grid
cells give components; extents over all directions bound a component's diameter from above, so a
component is proved a cluster without comparing its points. Only components that this doesn't
settle are looked at again on finer grids, and last point by point: then each point counts once, in
the component that it has over all cells, and one task resolves a component.

Defined results
* a record given several times counts once, by its latest delivery
* records with a null in any feature or one outside the bounds are in no cluster, nor in the k-means
* equal records are 0 apart; a cluster needs ``least`` different ids
* clusters are disjoint; where sets overlap, larger ones come first, then those of the smallest id
* an empty table has no clusters
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sixline.llm.spread import spread
from sixline.operators import mesh
from sixline.session import cut

#: Number of centroids, seeding rounds, candidates of a round for each centroid, Lloyd passes.
K, ROUNDS, OVERSAMPLING, PASSES = 96, 4, 2, 3
#: Slots of a hashed vector.
SLOTS = 8


def slots(features: Sequence[str], size: int = SLOTS) -> list[tuple[int, float]]:
    """Slot and sign of each feature by hashing its name; the first salt without collisions, if there is one, so that distances hold."""
    import hashlib

    best = None
    for salt in range(2000):
        at = []
        for f in features:
            h = int.from_bytes(hashlib.blake2b(f"{salt}:{f}".encode(), digest_size=8).digest(), "big")
            at.append((h % size, 1.0 if h >> 63 else -1.0))
        if best is None or len({a for a, _ in at}) > len({a for a, _ in best}):
            best = at
        if len({a for a, _ in best}) == min(size, len(features)):
            break
    return best


def hashed(weights: dict[str, float], size: int = SLOTS):
    """Matrix that takes feature columns to hashed weighted vectors."""
    m = np.zeros((len(weights), size))
    for i, (w, (slot, sign)) in enumerate(zip(weights.values(), slots(list(weights), size))):
        m[i, slot] += sign * w
    return m[:, np.abs(m).sum(0) > 0]  # slots that no feature has are 0 everywhere


def usable(df: DataFrame, key: str, features: Sequence[str], version: str | None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One row per key with all features within the bounds: the latest delivery, ties by value."""
    state = F.max(F.struct(*([F.col(version).alias("_version")] if version else []), *[F.col(c) for c in features])).alias("_s")
    one = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(state)
    inside = [F.col(f"_s.{c}").between(low, high) & ~F.isnan(f"_s.{c}") for c in features]
    keep = inside[0]
    for c in inside[1:]:
        keep = keep & c
    return one.filter(keep).select("id", *[F.col(f"_s.{c}").cast("double").alias(f"x{i}") for i, c in enumerate(features)])


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(d)], 1) if batch.num_rows else np.zeros((0, d))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def _near(x: np.ndarray, c: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of ``c`` to each of x and its squared distance, in single precision: one product per block, small enough for the cache."""
    a = np.concatenate([-2 * c.T, (c * c).sum(1)[None]]).astype(np.float32)
    ones = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), block):
        m = ones[i : i + block] @ a
        at[i : i + block] = k = m.argmin(1)
        far[i : i + block] = m[np.arange(len(m)), k]
    return at, np.maximum(far + (x * x).sum(1), 0)


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) of each id, the same on every run and in every partition."""
    z = ids.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def _sampled(points: DataFrame, project: np.ndarray, seeds: np.ndarray, salt: int, n: int) -> np.ndarray:
    """``n`` points drawn with chances by their squared distance to the seeds: the greatest keys log(u)/d²."""
    d, size = project.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 2 + size))
        for batch in batches:
            x = _matrix(batch, d) @ project
            ids = batch.column(0).to_numpy()
            far = _near(x, seeds)[1] if len(seeds) else np.ones(len(x))
            with np.errstate(divide="ignore"):
                # Points on a seed can't be drawn; below this, single precision doesn't tell.
                key = np.where(far > 1e-6, np.log(_uniform(ids, salt)) / far, -np.inf)
            kept = np.concatenate([kept, np.column_stack([key, ids.astype(float), x])])
            kept = kept[np.lexsort((kept[:, 1], -kept[:, 0]))[:n]]
        kept = kept[np.isfinite(kept[:, 0])]
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(2 + size)], names)

    names = ["key", "id", *[f"v{i}" for i in range(size)]]
    top = points.mapInArrow(run, ", ".join(f"{c} double" for c in names)).orderBy(F.desc("key"), "id").limit(n)
    return np.array([list(r)[2:] for r in top.collect()]).reshape(-1, size)


def _sums(points: DataFrame, project: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Per centroid: the number of points nearest to it and the sum of their vectors."""
    d, size = project.shape
    names = [f"v{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), 1 + size))
        for batch in batches:
            x = _matrix(batch, d) @ project
            near = _near(x, centroids)[0]
            total[:, 0] += np.bincount(near, minlength=len(centroids))
            for i in range(size):
                total[:, 1 + i] += np.bincount(near, x[:, i], len(centroids))
        has = np.nonzero(total[:, 0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(has)] + [pa.array(total[has, i]) for i in range(1 + size)], ["c", "n", *names])

    rows = points.mapInArrow(run, "c long, n double, " + ", ".join(f"{v} double" for v in names)).groupBy("c").agg(F.sum("n"), *[F.sum(v) for v in names]).collect()
    out = np.zeros((len(centroids), 1 + size))
    for r in rows:
        out[r[0]] = r[1:]
    return out


def fit(points: DataFrame, project: np.ndarray, k: int = K, rounds: int = ROUNDS, passes: int = PASSES) -> np.ndarray:
    """Centroids of the points (id, x0, x1, ...)."""
    size = project.shape[1]
    seeds = _sampled(points, project, np.zeros((0, size)), 0, 1)
    if not len(seeds):
        return seeds
    for i in range(rounds):
        seeds = np.concatenate([seeds, _sampled(points, project, seeds, 1 + i, OVERSAMPLING * k)])
    weights = _sums(points, project, seeds)[:, 0]
    # Weighted seeding among the candidates, then a few passes over them, all of bounded size.
    rng, chosen = np.random.default_rng(5), [int(weights.argmax())]
    near = _squared(seeds, seeds[chosen]).min(1)
    while len(chosen) < min(k, len(seeds)):
        chance = near * np.maximum(weights, 1e-9)
        if chance.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(seeds), p=chance / chance.sum())))
        near = np.minimum(near, _squared(seeds, seeds[chosen[-1:]])[:, 0])
    centroids = seeds[chosen]
    for _ in range(passes):
        got = _sums(points, project, centroids)
        centroids = np.where(got[:, :1] > 0, got[:, 1:] / np.maximum(got[:, :1], 1), centroids)
    return centroids


def nearest(points: DataFrame, project: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """id, centroid, distance."""
    d = project.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _squared(_matrix(batch, d) @ project, centroids)
            at = far.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(at)), at]))], ["id", "centroid", "distance"])

    return points.mapInArrow(run, "id long, centroid int, distance double")


def groups(df: DataFrame, key: str, weights: dict[str, float], version: str | None = None, k: int = K, typical: int = 3) -> DataFrame:
    """cluster, size, rank, id, distance: each k-means group by its size and the members nearest its centroid."""
    points = cut(spread(usable(df, key, list(weights), version), "id"))
    project = hashed(weights)
    centroids = fit(points, project, k)
    if not len(centroids):
        return points.select(F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("size"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("distance")).limit(0)
    at = nearest(points, project, centroids)
    # The row limit within the window is applied before the shuffle as well, so a large group sends few rows.
    first = at.withColumn("rank", F.row_number().over(Window.partitionBy("centroid").orderBy("distance", "id"))).filter(F.col("rank") <= typical)
    size = at.groupBy("centroid").agg(F.count(F.lit(1)).alias("size"))
    return first.join(size, "centroid").select(F.col("centroid").alias("cluster"), "size", "rank", "id", F.round("distance", 6).alias("distance"))


def described(found: DataFrame, df: DataFrame, key: str, features: Sequence[str], version: str | None = None, typical: int = 3) -> DataFrame:
    """cluster_id, size, rank, id, distance: the clusters of (cluster_id, id) by their size and the members nearest to their mean.

    Means are partial sums; the row limit of the ranks is applied before the shuffle, so a cluster with a large part of all records sends few.
    """
    names = [f"x{i}" for i in range(len(features))]
    member = cut(found.join(usable(df, key, features, version), "id"))
    mean = member.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), *[F.avg(n).alias(f"m_{n}") for n in names])
    gap = [F.col(n) - F.col(f"m_{n}") for n in names]
    far = member.join(mean, "cluster_id").withColumn("distance", F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0])))
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("distance", "id"))).filter(F.col("rank") <= typical)
    return ranked.select("cluster_id", "size", "rank", "id", F.round("distance", 6).alias("distance"))


# --- Tight clusters ----------------------------------------------------------------------------


def directions(d: int) -> np.ndarray:
    """Unit vectors along the axes, their pairs and all of them, with all signs but for the opposite."""
    out = [np.eye(d)[i] for i in range(d)]
    for i, j in itertools.combinations(range(d), 2):
        for s in (1, -1):
            v = np.zeros(d)
            v[i], v[j] = 1, s
            out.append(v)
    if 2 < d <= 6:
        out += [np.array((1, *s), float) for s in itertools.product((1, -1), repeat=d - 1)]
    return np.array([v / np.linalg.norm(v) for v in out])


def _widest(low: np.ndarray, high: np.ndarray, d: int) -> float:
    """Upper bound of the diameter of points with these extents along :func:`directions`.

    In up to four dimensions every vector lies within arccos 0.8535 of one of the directions.
    """
    wide = high - low
    box = float(np.sqrt((wide[:d] ** 2).sum()))
    return min(box, float(wide.max()) / 0.8535) if d in (3, 4) else box


def _parts(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Component label of each of n nodes, of links given in blocks."""
    label = np.arange(n)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                label[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(n)], int)


def _links(low: np.ndarray, high: np.ndarray, radius: float, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes that are at most ``radius`` apart; sorted along the first axis so that far ones aren't compared."""
    order = np.argsort(low[:, 0], kind="stable")
    lo, hi = low[order], high[order]
    for a in range(0, len(lo), block):
        la, ha = lo[a : a + block], hi[a : a + block]
        stop = np.searchsorted(lo[:, 0], ha[:, 0].max() + radius * 1.0001, "right")
        for b in range(a, stop, block):
            gap = np.maximum(0, np.maximum(lo[None, b : min(stop, b + block)] - ha[:, None], la[:, None] - hi[None, b : min(stop, b + block)]))
            i, j = np.nonzero((gap**2).sum(2) <= radius * radius * (1 + 1e-9))
            yield order[a + i], order[b + j]


def _linked(x: np.ndarray, radius: float, block: int = 1024) -> np.ndarray:
    """Component label of each point by links within ``radius``: what is reached leaves the search, so a dense group costs few comparisons."""
    limit = radius * radius * (1 + 1e-9)
    label, left, part = np.zeros(len(x), int), np.arange(len(x)), -1
    while len(left):
        part += 1
        front, left = left[:1], left[1:]
        label[front] = part
        while len(front) and len(left):
            near = (_squared(x[front[:block]], x[left]) <= limit).any(0)
            found = left[near]
            label[found] = part
            left, front = left[~near], np.r_[front[block:], found]
        label[front] = part
    return label


def _degrees(x: np.ndarray, radius: float, block: int = 1024) -> np.ndarray:
    """How many points, itself included, each point has within ``radius``; in blocks, so no matrix of all pairs is held."""
    limit = radius * radius * (1 + 1e-9)
    return np.concatenate([(_squared(x[i : i + block], x) <= limit).sum(1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, int)


def _clique(x: np.ndarray, radius: float) -> np.ndarray:
    """Points of which every two are within ``radius``: the one with the fewest others in reach leaves until that holds."""
    limit = radius * radius * (1 + 1e-9)
    at, degree = np.arange(len(x)), _degrees(x, radius)
    while len(at) and degree.min() < len(at):
        out = int(degree.argmin())
        near = _squared(x[at[out : out + 1]], x[at])[0] <= limit
        degree = np.delete(degree - near, out)
        at = np.delete(at, out)
    return at


#: Components up to so many points are searched exactly, with so many steps.
EXACT, STEPS = 400, 200_000


def _most(near: list[int], free: int, steps: list[int], least: int = 0) -> int:
    """Size of the largest set of pairwise near points among the bits of ``free``, or ``least`` if none is larger: branch and bound by colours."""
    best = least

    def grow(free: int, size: int) -> None:
        nonlocal best
        steps[0] -= 1
        if steps[0] < 0:
            raise OverflowError
        # Points of one colour are not near each other: a set takes one of each at most.
        order, colours, rest, colour = [], [], free, 0
        while rest:
            colour += 1
            same = rest
            while same:
                bit = same & -same
                v = bit.bit_length() - 1
                order.append(v)
                colours.append(colour)
                rest ^= bit
                same = (same ^ bit) & ~near[v]
        for v, colour in zip(reversed(order), reversed(colours)):
            if size + colour <= best:
                return
            below = free & near[v]
            if below:
                grow(below, size + 1)
            elif size + 1 > best:
                best = size + 1
            free ^= 1 << v

    grow(free, 0)
    return best


def _exact(x: np.ndarray, radius: float) -> np.ndarray | None:
    """The largest set of points within ``radius`` of each other, of equal ones the first by index; None where the steps run out."""
    n = len(x)
    matrix = _squared(x, x) <= radius * radius * (1 + 1e-9)
    np.fill_diagonal(matrix, False)
    near = [int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little") for row in matrix]
    steps = [STEPS]
    try:
        size = _most(near, (1 << n) - 1, steps)
        out, free = [], (1 << n) - 1
        for v in range(n):
            if len(out) < size and free >> v & 1:
                below = free & near[v]
                need = size - len(out) - 1
                if need == 0 or bin(below).count("1") >= need and _most(near, below, steps, need - 1) >= need:
                    out.append(v)
                    free = below
        return np.array(out)
    except OverflowError:
        return None


def largest(x: np.ndarray, ids: np.ndarray, radius: float, least: int) -> list[np.ndarray]:
    """Disjoint sets of at least ``least`` points of which every two are at most ``radius`` apart, largest first; indices into ``ids``.

    Points with fewer than ``least`` in reach are left out first, again and again, and components are
    taken apart. Components up to ``EXACT`` points are searched exactly (of equal sets that of the
    smallest ids), larger ones greedily around their points, those with most others in reach first;
    memory grows with the points, not with their pairs.
    """
    limit = radius * radius * (1 + 1e-9)
    out, work = [], [np.arange(len(x))]
    while work:
        at = work.pop()
        at = at[np.argsort(ids[at], kind="stable")]
        degree = _degrees(x[at], radius)
        while len(at) and degree.min() < least:
            at = at[degree >= least]
            degree = _degrees(x[at], radius)
        if len(at) < least:
            continue
        label = _linked(x[at], radius)
        if label.max() > 0:
            work += [at[label == part] for part in np.unique(label)[::-1]]
            continue
        if degree.min() == len(at):
            out.append(at)
            continue
        best = _exact(x[at], radius) if len(at) <= EXACT else None
        if best is not None:
            if len(best) >= least:
                out.append(at[best])
                work.append(np.delete(at, best))
            continue
        best, held = np.zeros(0, int), np.zeros(len(at), bool)
        for seed in np.argsort(-degree, kind="stable"):
            if degree[seed] <= len(best):
                break
            if held[seed]:
                continue
            near = np.nonzero(_squared(x[at[seed : seed + 1]], x[at])[0] <= limit)[0]
            made = near[_clique(x[at[near]], radius)]
            if len(made) > len(best):
                best = made
                held[best] = True
        if len(best) >= least:
            out.append(at[best])
            work.append(np.delete(at, best))
    return sorted(out, key=lambda s: (-len(s), int(ids[s].min())))


def _cells(centroids: np.ndarray, radius: float) -> np.ndarray:
    """Cell of each centroid: those within the radius of each other share one, else a tight cluster with several would be copied to each."""
    return np.unique(_parts(len(centroids), _links(centroids, centroids, radius)), return_inverse=True)[1]


def _in_cells(x: np.ndarray, project: np.ndarray, centroids: np.ndarray, cell: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, core) of each cell that a row belongs to, by its nearest centroid or by the halo."""
    far = _squared(x @ project, centroids)
    nearest_ = far.argmin(1)
    own = cell[nearest_]
    reach = (np.sqrt(far[np.arange(len(far)), nearest_]) + 4 * radius + 1e-6) ** 2
    row, c = np.nonzero(far <= reach[:, None])
    pair = np.unique(row * np.int64(cell.max() + 1) + cell[c])
    row, at = pair // (cell.max() + 1), (pair % (cell.max() + 1)).astype(np.int32)
    return row, at, own[row] == at


def tight(df: DataFrame, key: str, weights: dict[str, float], radius: float, least: int = 5, version: str | None = None, k: int = K) -> DataFrame:
    """cluster_id, id: the sets of at least ``least`` ids of which every two are at most ``radius`` apart by the features."""
    d = len(weights)
    points = cut(spread(usable(df, key, list(weights), version), "id"))
    project = hashed(weights)
    centroids = fit(points, project, k)
    if not len(centroids):
        return points.select(F.col("id").alias("cluster_id"), "id").limit(0)
    cell, ways = _cells(centroids, radius), directions(d)
    scale = np.array(list(weights.values()), float)
    n = len(ways)
    extents = [f"{e}{i}" for i in range(n) for e in ("l", "h")]

    def grid(x: np.ndarray, side: float) -> np.ndarray:
        g = np.floor(x * scale / side).astype(np.int64)
        code = np.zeros(len(x), np.int64)
        for i in range(d):
            code = code * 1_000_003 + g[:, i]
        return code

    def members(side: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch, d)
                    row, at, core = _in_cells(x, project, centroids, cell, radius)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), pa.array(at), pa.array(core), pa.array(grid(x, side)[row])] + [batch.column(1 + i).take(take) for i in range(d)],
                        ["id", "cell", "core", "g", *[f"x{i}" for i in range(d)]],
                    )

        return run

    member = "id long, cell int, core boolean, g long, " + ", ".join(f"x{i} double" for i in range(d))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (cell, part, g) with number, ids and extents: reduced per batch here, over all batches by the aggregation that follows."""
        big = np.iinfo(np.int64).max
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
            x = np.stack([t[f"x{i}"] for i in range(d)], 1) * scale
            order = np.lexsort((t["g"], t["part"], t["cell"]))
            c, p, g = t["cell"][order], t["part"][order], t["g"][order]
            start = np.nonzero(np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1]) | (g[1:] != g[:-1])])[0]
            along = (x @ ways.T)[order]
            ids = t["id"][order]
            low, high = np.minimum.reduceat(along, start), np.maximum.reduceat(along, start)
            columns = [c[start], p[start], g[start], np.diff(np.r_[start, len(c)]), np.minimum.reduceat(ids, start), np.minimum.reduceat(np.where(t["core"][order], ids, big), start)]
            for i in range(n):
                columns += [low[:, i], high[:, i]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["cell", "part", "g", "n", "least_id", "core_id", *extents])

    summary = "cell int, part long, g long, n long, least_id long, core_id long, " + ", ".join(f"{e} double" for e in extents)

    def settle(frame):
        """Components of one cell's grid: proved clusters, those too small, and those to look at again."""
        import pandas as pd

        frame = frame.sort_values(["part", "g"], ignore_index=True)
        low, high = frame[[f"l{i}" for i in range(n)]].to_numpy(), frame[[f"h{i}" for i in range(n)]].to_numpy()
        label = _parts(len(frame), _links(low[:, :d], high[:, :d], radius))
        rows = []
        for part in np.unique(label):
            at = np.nonzero(label == part)[0]
            first, core = int(frame["least_id"].iloc[at].min()), int(frame["core_id"].iloc[at].min())
            if frame["n"].iloc[at].sum() < least or core == np.iinfo(np.int64).max:
                continue
            proved = _widest(low[at].min(0), high[at].max(0), d) <= radius
            if not proved or core == first:
                rows += [(int(frame["cell"].iloc[i]), int(frame["part"].iloc[i]), int(frame["g"].iloc[i]), first, proved) for i in at]
        return pd.DataFrame(rows, columns=["cell", "part", "g", "first", "proved"])

    def by_points(frame):
        import pandas as pd

        x, ids = frame[[f"x{i}" for i in range(d)]].to_numpy() * scale, frame["id"].to_numpy()
        rows = [(int(ids[at].min()), int(i)) for at in largest(x, ids, radius, least) for i in ids[at]]
        return pd.DataFrame(rows, columns=["cluster_id", "id"]).astype("int64")

    def components(left: DataFrame) -> DataFrame:
        """The points with the component they have over all cells, by links of grid cells of the radius' width."""
        side = [f"c{i}" for i in range(d)]
        at = left.select("*", *[F.floor(F.col(f"x{i}") * float(scale[i]) / radius).alias(c) for i, c in enumerate(side)]).withColumn("g", F.xxhash64(*side))
        boxes = at.groupBy("g", *side).agg(*[f(F.col(f"x{i}") * float(scale[i])).alias(f"{e}{i}") for i in range(d) for f, e in ((F.min, "l"), (F.max, "h"))])
        boxes = cut(boxes)
        near = boxes
        for c in side:
            near = near.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
        a, b = near.alias("a"), boxes.alias("b")
        gap = [F.greatest(F.lit(0.0), F.col(f"b.l{i}") - F.col(f"a.h{i}"), F.col(f"a.l{i}") - F.col(f"b.h{i}")) for i in range(d)]
        linked = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in side]).filter(sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= radius * radius * (1 + 1e-9))
        part = mesh.components(linked.select(F.col("a.g").alias("source"), F.col("b.g").alias("found")))
        return at.join(part.select(F.col("id").alias("g"), "component"), "g").select("component", "id", *[f"x{i}" for i in range(d)])

    salts = 16
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")

    def matched(rows: DataFrame, found: DataFrame) -> DataFrame:
        # A grid cell may hold a large part of all points: its rows are spread by salt, the small side is repeated.
        wide = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return rows.select("*", salt).join(wide, ["cell", "part", "g", "salt"]).drop("salt")

    rows = points.mapInArrow(members(radius), member).withColumn("part", F.lit(0).cast("long"))
    out = None
    for side in (radius, radius / 4, None):
        if side is None:
            left = rows.filter("core").select("id", *[f"x{i}" for i in range(d)]).dropDuplicates(["id"])
            # What another cell has proved is a component of its own.
            left = cut(left if out is None else left.join(out.select(F.col("id").alias("_done")), F.col("id") == F.col("_done"), "left_anti"))
            done = components(left).groupBy("component").applyInPandas(by_points, "cluster_id long, id long")
            return done if out is None else out.unionAll(done)
        order = ["id", "cell", "core", "g", *[f"x{i}" for i in range(d)], "part"]
        small = rows.select(order).mapInArrow(summarise, summary).groupBy("cell", "part", "g").agg(
            F.sum("n").alias("n"), F.min("least_id").alias("least_id"), F.min("core_id").alias("core_id"),
            *[(F.min if e[0] == "l" else F.max)(e).alias(e) for e in extents],
        )
        found = cut(small.groupBy("cell").applyInPandas(settle, "cell int, part long, g long, first long, proved boolean"))
        done = matched(rows, found.filter("proved")).select(F.col("first").alias("cluster_id"), "id")
        out = done if out is None else out.unionAll(done)
        if found.filter("NOT proved").isEmpty():
            return out
        left = matched(rows, found.filter("NOT proved")).drop("part", "proved").withColumnRenamed("first", "part")
        finer = side / 4
        fine = [F.floor(F.col(f"x{i}") * float(scale[i]) / finer) for i in range(d)]
        rows = cut(left.withColumn("g", F.xxhash64(*fine)).select("id", "cell", "core", "g", *[f"x{i}" for i in range(d)], "part"))
    return out
