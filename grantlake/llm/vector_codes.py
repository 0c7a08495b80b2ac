"""Product codes of vectors by exact rounds of k-means over anchors-hierarchy metric trees.

Components become integers, vectors are cut into ``PARTS`` equal parts, and each part position has a
codebook of ``ENTRIES`` integer entries. Vectors are stored once as blocks of up to ``BLOCK_ROWS``.
Over each part of a block stands a metric tree, built middle-out: some square root of n anchors take the
points nearest to them (each new anchor is the farthest point of the widest anchor, and steals only where
the triangle inequality leaves it a chance), anchors are split further in the same way, and balls are
merged pairwise, the tightest union first, into the tree above. A ball caches the sum and the number of
its points.

A round walks all trees level by level. A ball inherits the entries that are still possible for its
points, and drops those that another entry beats at every place of the ball; a ball with one entry left
gives it the cached sum and number and is not opened. Only in leaves with several entries left are
points held against entries, in whole numbers. So assignments are exact, ties included (lower index).
Only sums per (part, entry) leave a task; the driver holds the codebooks.

Results for odd input: rows whose vector is null or holds null or non-finite components are dropped. Vectors
of different dimensions have codebooks of their own; a dimension that ``PARTS`` does not divide is filled up
with zeros; an empty vector has error 0. Of a repeated ``vec_id`` the smallest vector counts as a start, and all
rows are coded; a null ``vec_id`` is coded but is no start. With fewer than ``ENTRIES`` ids the codebooks are
that short, without any id they are empty: code and error are null. Components beyond 2**26 in size
count as 2**26. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import texts
from .scratch import Scratch

PARTS, ENTRIES, ROUNDS = 8, 16, 6
BLOCK_ROWS = 8192
LEAF = 32
LIMIT = float(1 << 26)
BLOCK = "dim int, n int, ids array<long>, labels array<string>, points binary, trees array<binary>"

Codebooks = dict[int, np.ndarray]  # dimension -> (PARTS, entries, width)


def anchors(points: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Members of up to ``wanted`` anchors: positions in ``points``, each with the anchor it is nearest to."""
    dist = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    by_far = np.argsort(-dist, kind="stable")
    held = [(by_far, dist[by_far])]
    pivots = [points[0]]
    while len(held) < wanted:
        widest = max(range(len(held)), key=lambda k: held[k][1][0])
        if held[widest][1][0] <= 0:
            break
        pivot = points[held[widest][0][0]]
        away = np.sqrt(((np.array(pivots) - pivot) ** 2).sum(axis=1))
        won, won_dist = [], []
        for k, (members, far) in enumerate(held):
            reach = int(np.searchsorted(-far, -away[k] / 2, side="right"))  # nearer members can't change over
            if not reach:
                continue
            to_new = np.sqrt(((points[members[:reach]] - pivot) ** 2).sum(axis=1))
            goes = to_new < far[:reach]
            if goes.any():
                won.append(members[:reach][goes])
                won_dist.append(to_new[goes])
                stays = np.append(~goes, np.ones(len(members) - reach, dtype=bool))
                held[k] = (members[stays], far[stays])
        if not won:
            break
        members, far = np.concatenate(won), np.concatenate(won_dist)
        by_far = np.argsort(-far, kind="stable")
        held.append((members[by_far], far[by_far]))
        pivots.append(pivot)
    return [members for members, _ in held]


class Builder:
    """A tree over one part of a block. ``left`` of a leaf is -1 and its members are in ``members``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.left: list[int] = []
        self.right: list[int] = []
        self.members: list[np.ndarray | None] = []

    def node(self, left: int, right: int, members: np.ndarray | None) -> int:
        self.left.append(left)
        self.right.append(right)
        self.members.append(members)
        return len(self.left) - 1

    def grow(self, index: np.ndarray) -> int:
        if len(index) <= LEAF:
            return self.node(-1, -1, index)
        groups = anchors(self.points[index], int(np.ceil(np.sqrt(len(index)))))
        if len(groups) == 1:
            return self.node(-1, -1, index)
        centres, radii, sizes, nodes = [], [], [], []
        for group in groups:
            own = self.points[index[group]]
            centres.append(own.mean(axis=0))
            radii.append(np.sqrt(((own - centres[-1]) ** 2).sum(axis=1).max()))
            sizes.append(len(group))
            nodes.append(self.grow(index[group]))
        return self.merge(np.array(centres), np.array(radii), np.array(sizes, dtype=np.float64), nodes)

    def merge(self, centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray, nodes: list[int]) -> int:
        """Join the two balls with the smallest common ball until one is left."""
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
        common = np.maximum((apart + radii[:, None] + radii[None]) / 2, np.maximum(radii[:, None], radii[None]))
        common[np.tril_indices(len(nodes))] = np.inf
        for _ in range(len(nodes) - 1):
            a, b = divmod(int(common.argmin()), len(nodes))
            nodes[a] = self.node(nodes[a], nodes[b], None)
            centre = (centres[a] * sizes[a] + centres[b] * sizes[b]) / (sizes[a] + sizes[b])
            ends = [np.sqrt(((centre - centres[k]) ** 2).sum()) + radii[k] for k in (a, b)]
            centres[a], radii[a], sizes[a] = centre, max(ends), sizes[a] + sizes[b]
            live = np.isfinite(common).any(axis=0) | np.isfinite(common).any(axis=1)
            live[[a, b]] = False
            to_all = np.sqrt(((centres - centre) ** 2).sum(axis=1))
            joint = np.where(live, np.maximum((to_all + radii + radii[a]) / 2, np.maximum(radii, radii[a])), np.inf)
            common[b, :] = common[:, b] = np.inf
            common[a, a + 1 :] = joint[a + 1 :]
            common[:a, a] = joint[:a]
        return nodes[a]


class Tree:
    """A finished tree: nodes with ranges of ``order``, cached sums and radii around their means; the root is first."""

    FIELDS = (("left", "<i4"), ("right", "<i4"), ("start", "<i4"), ("size", "<i4"), ("radius", "<f8"))

    @classmethod
    def build(cls, points: np.ndarray) -> "Tree":
        made = Builder(points.astype(np.float64))
        root = made.grow(np.arange(len(points)))
        self = cls()
        rows: list[tuple[int, int, int, int]] = []
        order: list[np.ndarray] = []
        place: dict[int, int] = {}
        at, stack = 0, [(root, False)]
        while stack:
            node, done = stack.pop()
            left, right, members = made.left[node], made.right[node], made.members[node]
            if done:
                start = rows[place[left]][2]
                rows[place[node]] = (place[left], place[right], start, at - start)
                continue
            place[node] = len(rows)
            if members is None:
                rows.append((-1, -1, 0, 0))
                stack += [(node, True), (right, False), (left, False)]
            else:
                rows.append((-1, -1, at, len(members)))
                order.append(members)
                at += len(members)
        self.left, self.right, self.start, self.size = np.array(rows, dtype=np.int32).T
        self.order = np.concatenate(order).astype(np.int32)
        laid = points[self.order].astype(np.int64)
        total = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(laid, axis=0)))
        self.sums = total[self.start + self.size] - total[self.start]
        self.radius = np.zeros(len(rows))
        for k, (start, size) in enumerate(zip(self.start.tolist(), self.size.tolist())):
            away = laid[start : start + size] - self.sums[k] / size
            self.radius[k] = np.sqrt(np.einsum("ij,ij->i", away, away).max()) * (1 + 1e-12)
        return self

    def to_bytes(self) -> bytes:
        head = np.array([len(self.left), len(self.order)], dtype="<i8")
        body = [getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS]
        return b"".join([head.tobytes(), *body, self.order.astype("<i4").tobytes(), self.sums.astype("<i8").tobytes()])

    @classmethod
    def of_bytes(cls, data: bytes, width: int) -> "Tree":
        self = cls()
        nodes, n = np.frombuffer(data, "<i8", 2).tolist()
        at = 16
        for name, kind in cls.FIELDS:
            setattr(self, name, np.frombuffer(data, kind, nodes, at))
            at += nodes * np.dtype(kind).itemsize
        self.order = np.frombuffer(data, "<i4", n, at)
        self.sums = np.frombuffer(data, "<i8", nodes * width, at + 4 * n).reshape(nodes, width)
        return self

    def assign(self, points: np.ndarray, entries: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sums and numbers of points by entry and, if ``each``, every point's entry."""
        k, width = entries.shape
        at = entries.astype(np.float64)
        apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        chosen = np.zeros(len(points), np.int64) if each else None
        first = np.array([not any((entries[e] == entries[f]).all() for f in range(e)) for e in range(k)])
        front, possible = np.zeros(1, np.int64), first[None].copy()
        leaves, leaf_possible = [], []
        while len(front):
            centre = self.sums[front] / self.size[front][:, None]
            dist = ((centre[:, None] - at[None]) ** 2).sum(axis=2)
            best = np.where(possible, dist, np.inf).argmin(axis=1)
            nearest = dist[np.arange(len(front)), best][:, None]
            spread = 2 * self.radius[front][:, None] * apart[best]
            # the most by which the best entry can be farther than another, over the whole ball
            beaten = nearest - dist + spread < -1e-9 * (nearest + dist + spread) - 1e-6
            possible &= ~beaten
            owned = possible.sum(axis=1) == 1
            if owned.any():
                nodes, entry = front[owned], possible[owned].argmax(axis=1)
                np.add.at(sums, entry, self.sums[nodes])
                np.add.at(counts, entry, self.size[nodes].astype(np.int64))
                if each:
                    inside = texts.ranges(self.start[nodes].astype(np.int64), self.size[nodes].astype(np.int64))
                    chosen[self.order[inside]] = np.repeat(entry, self.size[nodes])
            leaf = ~owned & (self.left[front] < 0)
            leaves.append(front[leaf])
            leaf_possible.append(possible[leaf])
            opened = ~owned & ~leaf
            front, possible = np.concatenate((self.left[front[opened]], self.right[front[opened]])), np.concatenate((possible[opened], possible[opened]))
        node, mask = np.concatenate(leaves), np.concatenate(leaf_possible)
        inside = self.order[texts.ranges(self.start[node].astype(np.int64), self.size[node].astype(np.int64))]
        mask = np.repeat(mask, self.size[node], axis=0)
        for k0 in range(0, len(inside), 2048):
            part = inside[k0 : k0 + 2048]
            own = points[part].astype(np.int64)
            dist = ((own[:, None] - entries[None]) ** 2).sum(axis=2)
            entry = np.where(mask[k0 : k0 + 2048], dist, np.iinfo(np.int64).max).argmin(axis=1)
            np.add.at(sums, entry, own)
            np.add.at(counts, entry, 1)
            if each:
                chosen[part] = entry
        return sums, counts, chosen


def width_of(dim: int) -> int:
    return -(-dim // PARTS)


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """Integer components, filled up to ``PARTS`` equal parts."""
    rows, dim = values.shape
    out = np.zeros((rows, PARTS * width_of(dim)), dtype=np.int32)
    with np.errstate(over="ignore"):
        out[:, :dim] = np.clip(np.floor(scale * values), -LIMIT, LIMIT)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), embedding of rows with a vector of finite components."""
    bad = float("nan"), float("inf"), float("-inf")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~x.isin(*bad))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    return vectors.select(F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<double>")).where(F.col("embedding").isNotNull() & finite)


def blocks(kept: DataFrame, scale: float) -> DataFrame:
    """Blocks of integer vectors of one dimension with a tree for each part."""

    def block(dim: int, held: list[tuple]) -> pa.RecordBatch:
        ids, labels = [i for h in held for i in h[0]], [i for h in held for i in h[1]]
        points = np.concatenate([h[2] for h in held])
        width = width_of(dim)
        trees = [Tree.build(points[:, p * width : (p + 1) * width]).to_bytes() for p in range(PARTS)]
        columns = [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([points.tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], ["dim", "n", "ids", "labels", "points", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = np.asarray(pa.compute.list_value_length(vectors)).astype(np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                points = whole(flat[first[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0)), scale)
                ids, labels = batch.column("vec_id").take(pa.array(at)).to_pylist(), batch.column("label").take(pa.array(at)).to_pylist()
                mine = held.setdefault(dim, [])
                mine.append((ids, labels, points))
                if sum(len(h[0]) for h in mine) >= BLOCK_ROWS:
                    yield block(dim, held.pop(dim))
        for dim, mine in held.items():
            yield block(dim, mine)

    return kept.mapInArrow(run, BLOCK)


def opened(batch: pa.RecordBatch, row: int, codebooks: Codebooks) -> Iterator[tuple[int, np.ndarray, Tree, np.ndarray]]:
    """Part number, points, tree and codebook of each part of a block."""
    dim = batch.column("dim")[row].as_py()
    width = width_of(dim)
    points = np.frombuffer(batch.column("points")[row].as_py(), np.int32).reshape(batch.column("n")[row].as_py(), PARTS * width)
    for p, data in enumerate(batch.column("trees")[row].as_py()):
        yield p, points[:, p * width : (p + 1) * width], Tree.of_bytes(data, width), codebooks[dim][p]


def starts(kept: DataFrame, scale: float) -> Codebooks:
    """Codebooks of the smallest ids, per dimension."""
    sized = kept.where("vec_id is not null").withColumn("dim", F.size("embedding"))
    ids = sized.groupBy("dim", "vec_id").agg(F.lit(1).alias("one"))
    ids = ids.withColumn("rank", F.row_number().over(W.partitionBy("dim").orderBy("vec_id"))).where(F.col("rank") <= ENTRIES)
    first = sized.join(F.broadcast(ids.select("dim", "vec_id")), ["dim", "vec_id"]).groupBy("dim", "vec_id").agg(F.min("embedding").alias("embedding"))
    out: Codebooks = {}
    for row in first.orderBy("dim", "vec_id").collect():  # ENTRIES rows of each dimension
        points = whole(np.array(row.embedding, dtype=np.float64).reshape(1, row.dim), scale).astype(np.int64)
        own = points.reshape(PARTS, 1, width_of(row.dim))
        out[row.dim] = np.concatenate((out[row.dim], own), axis=1) if row.dim in out else own
    return out


def updated(trees: DataFrame, codebooks: Codebooks) -> Codebooks:
    """One round: the mean of the parts that are nearest to each entry; entries without any stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column("dim")[row].as_py()
                if dim not in codebooks:
                    continue
                for p, points, tree, entries in opened(batch, row, codebooks):
                    sums, counts, _ = tree.assign(points, entries, each=False)
                    old = total.get((dim, p))
                    total[dim, p] = (sums, counts) if old is None else (old[0] + sums, old[1] + counts)
        rows = [(dim, p, e, int(counts[e]), sums[e].tolist()) for (dim, p), (sums, counts) in total.items() for e in np.flatnonzero(counts).tolist()]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["dim", "part", "entry", "n", "sums"])

    found = trees.mapInArrow(run, "dim int, part int, entry int, n long, sums array<long>")
    means = found.select("dim", "part", "entry", "n", F.posexplode("sums").alias("place", "s")).groupBy("dim", "part", "entry", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    new = {dim: book.copy() for dim, book in codebooks.items()}
    for r in means.collect():  # ENTRIES numbers per component
        new[r.dim][r.part, r.entry, r.place] = r.s // r.n
    return new


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def coded(trees: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every vector."""
    digests = {dim: digest(book) for dim, book in codebooks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, n = batch.column("dim")[row].as_py(), batch.column("n")[row].as_py()
                error, codes = np.zeros(n, np.int64), np.zeros((n, PARTS), np.uint8)
                known = dim in codebooks
                for p, points, tree, entries in opened(batch, row, codebooks) if known else ():
                    chosen = tree.assign(points, entries, each=True)[2]
                    error += ((points.astype(np.int64) - entries[chosen]) ** 2).sum(axis=1)
                    codes[:, p] = chosen
                text = codes.tobytes().hex()
                size = 2 * PARTS
                columns = [batch.column("ids")[row].values, batch.column("labels")[row].values]
                columns.append(pa.array([text[k : k + size] for k in range(0, size * n, size)] if known else [None] * n, pa.string()))
                columns.append(pa.array(error.tolist() if known else [None] * n, pa.int64()))
                columns.append(pa.array([digests.get(dim)] * n, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return trees.mapInArrow(run, "vec_id long, label string, code string, error long, codebooks_sha256 string")


def learn(trees: DataFrame, codebooks: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    for _ in range(rounds):
        codebooks = updated(trees, codebooks)
    return codebooks


def encode(vectors: DataFrame, scale: float = 4096.0, rounds: int = ROUNDS) -> DataFrame:
    """Codes of ``vectors`` (vec_id, embedding and, if there is one, label), with label_error, the sum
    of the errors of all rows of the same label."""
    tables = Scratch(vectors.sparkSession, "codes")
    kept = usable(vectors)
    trees = tables.keep(blocks(kept, scale), "trees")
    found = tables.keep(coded(trees, learn(trees, starts(kept, scale), rounds)), "coded")
    tables.drop("trees")
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return found.join(sums, found.label.eqNullSafe(sums.of), "left").select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
