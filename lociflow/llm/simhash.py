"""SimHash near-duplicates, found exactly with vantage-point trees.

Texts get a 64-bit fingerprint of their word shingles. Equal fingerprints are one node. A tree of vantage points, fitted
on a bounded sample of the fingerprints, divides the Hamming space into shards by distance: within the radius, or beyond.
A fingerprint lives in one shard and also visits each shard that the triangle inequality can't exclude (distance to the
vantage point within RADIUS of the node's radius), so every pair within RADIUS differing bits meets in the home shard of
either. A shard goes on dividing in memory down to small leaves, whose distances are computed exactly, and gives back a
spanning forest of its links, never all pairs. Components of the forests' union are found by large-star and small-star
rounds of grouped minima, each written to the shared folder.

The sample only places the vantage points. A bad sample makes shards uneven, not wrong. Where it has run out, a node's
vantage point is a hash of the node's number, which halves unrelated fingerprints as well, so the tree goes as deep as the
fingerprints need and only FITTED levels are sent to the workers.

Defined cases: a text without words (null, blank) has fingerprint zero and is linked like any other; fewer words than a
shingle make one shingle; a text may be one unbroken run of any length; repeated rows share their component; a component
without any identifier has a null one; ties cannot arise, since a component's name is its smallest identifier; an empty
table gives an empty one; only the two named columns are read, so no other can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import cut, ship, uniform

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints that are expected in the sample.
SAMPLE = 32_768
#: A shard is to hold so many fingerprints of its own; there are MIN_DEPTH levels at least, FITTED ones by the sample.
SHARD = 8_192
MIN_DEPTH, FITTED = 9, 12
LEAF = 256
CANDIDATES = 12
MAX_ROUNDS = 60
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def text_fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 values have it."""
    found = [w for w in (text or "").translate(BLANKS).split(" ") if w]
    if not found:
        return 0
    if len(found) <= size:
        shingles = [" ".join(found)]
    else:
        shingles = map(" ".join, zip(*(found[i:] for i in range(size)), strict=False))
    digest, seed = xxhash.xxh64_digest, SEED
    hashes = b"".join([digest(s.encode("utf-8", "surrogatepass"), seed) for s in shingles])
    n, ones = len(hashes) // 8, np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 65_536):  # bits of a bounded part at a time
        ones += np.unpackbits(rows[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): fp holds the 64 bits in a signed long. A-Z are lower-cased first."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([text_fingerprint(None if t is None else t.translate(UPPER), size) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(each, f"id {kind}, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def choose(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """A vantage point and the radius that halves the points; of a few candidates the one whose boundary is least crowded."""
    best = None
    for v in points[rng.choice(len(points), min(CANDIDATES, len(points)), replace=False)]:
        d = distance(points, v)
        radius = int(np.median(d))
        for r in (radius - 1, radius, radius + 1):
            inside = int((d <= r).sum())
            crowd = int(((d > r - RADIUS) & (d <= r + RADIUS)).sum())
            cost = (max(inside, len(points) - inside), crowd)
            score = cost[0] + 0.5 * cost[1]
            if 0 < inside < len(points) and (best is None or score < best[0]):
                best = score, v, r
    return (best[1], best[2]) if best else (points[0], 0)


def unfitted(node: np.ndarray) -> np.ndarray:
    """Vantage points of nodes without a sample."""
    x = node.astype(np.uint64) + np.uint64(1)
    for shift in (31, 29, 32):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(30))


def fit_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full binary tree in heap order; node i has 2i + 1 within its radius, 2i + 2 beyond."""
    rng = np.random.default_rng(SEED)
    nodes = 2**depth - 1
    points, radii, held = np.zeros(nodes, np.uint64), np.zeros(nodes, np.int16), {0: sample}
    for i in range(nodes):
        own = held.pop(i)
        points[i], radii[i] = choose(own, rng) if len(own) > 1 else (unfitted(np.array([i]))[0], 32)
        near = distance(own, points[i]) <= radii[i] if len(own) else np.zeros(0, bool)
        held[2 * i + 1], held[2 * i + 2] = own[near], own[~near]
    return points, radii


def route(fps: np.ndarray, points: np.ndarray, radii: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of every shard that each fingerprint lives in or visits, `depth` levels down."""
    n = 2**depth - 1
    row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    while len(node) and node[0] < n:
        fitted = node[0] < len(points)  # all are of one level
        d, r = distance(fps[row], points[node] if fitted else unfitted(node)), radii[node] if fitted else np.full(len(node), 32, np.int16)
        near = d <= r
        go_in, go_out = d <= r + RADIUS, d > r - RADIUS
        row = np.concatenate([row[go_in], row[go_out]])
        home = np.concatenate([(home & near)[go_in], (home & ~near)[go_out]])
        node = np.concatenate([2 * node[go_in] + 1, 2 * node[go_out] + 2])
    return row, node - n, home


class Forest:
    """Union-find over positions; pairs come in arrays, and those that are tied already cost no step of their own."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def flatten(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        if not len(left):
            return
        up = self.flatten()
        apart = up[left] != up[right]
        for a, b in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def link_shard(fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of fingerprints, of the links with a home end in one shard. `fps` are distinct."""
    order = np.argsort(fps)
    fps, home = fps[order], home[order]
    forest, rng = Forest(len(fps)), np.random.default_rng(SEED)
    stack = [(np.flatnonzero(home), np.arange(len(fps)))]
    while stack:
        own, near = stack.pop()
        if not len(own) or len(near) < 2:
            continue
        split = None
        if len(own) > LEAF:
            v, r = choose(fps[own][:: max(1, len(own) // 1024)], rng)
            d, e = distance(fps[own], v), distance(fps[near], v)
            parts = [(own[d <= r], near[e <= r + RADIUS]), (own[d > r], near[e > r - RADIUS])]
            if max(len(o) * len(x) for o, x in parts) < 0.9 * len(own) * len(near):
                split = parts
        if split:
            stack += split
            continue
        for at in range(0, len(own), LEAF):
            some = own[at : at + LEAF]
            for to in range(0, len(near), 8 * LEAF):
                others = near[to : to + 8 * LEAF]
                i, j = np.nonzero(distance(fps[some][:, None], fps[others][None, :]) <= RADIUS)
                i, j = some[i], others[j]
                apart = i != j
                forest.join(i[apart], j[apart])
    roots = forest.flatten()
    tied = roots != np.arange(len(fps))
    return fps[tied], fps[roots[tied]]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): forests of the links between the fingerprints in the column `fp`, all different."""
    spark = distinct.sparkSession
    ship(spark)
    n = distinct.count()
    # a share by hash, not the first by order: no task sends more than its part of the sample
    drawn = distinct.where(uniform(F.lit(SEED), F.col("fp")) < SAMPLE / max(1, n)).select("fp").toPandas()["fp"].to_numpy(np.int64)
    depth = MIN_DEPTH
    while n > SHARD * 2**depth:
        depth += 1
    tree = spark.sparkContext.broadcast(fit_tree(np.sort(drawn).view(np.uint64), min(depth, FITTED)))  # 10 bytes a node, 2 ** FITTED nodes at most

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, radii = tree.value
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, shard, home = route(fps, points, radii, depth)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[row].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def linked(group: pa.Table) -> pa.Table:
        a, b = link_shard(group.column("fp").to_numpy().view(np.uint64), group.column("home").to_numpy(zero_copy_only=False))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(dealt, "shard long, fp long, home boolean").groupBy("shard").applyInArrow(linked, "a long, b long")


def are_stars(edges: DataFrame) -> bool:
    """Whether each node of edges (u, v) with u > v is either the lower end of its edges or the upper end of just one: then a
    component is one star, and its centre is its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge names; root is the smallest node of its component.

    A large-star round ties each node's greater neighbours to the smallest of its neighbourhood, a small-star round its
    smaller ones and itself. Minima are grouped with partial aggregation, written, and joined back: adaptive execution
    splits the edges of a node that has many, which it does only if the other side comes straight from a table.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for i in range(MAX_ROUNDS):
        if are_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"least-{i}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, f"large-{i}")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), f"lower-{i}")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = cut(small, f"small-{i}")
    else:
        raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest identifier that links reach, its own included."""
    marked = cut(fingerprints(documents, id_col, text_col, size), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "nodes")
    return named(marked, nodes, links(nodes.select("fp")), "fp").select("id", "fp", "component_id")


def named(marked: DataFrame, nodes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Add component_id to `marked`: the smallest first_id of the component of its node."""
    rooted = cut(components(found), "roots").withColumnRenamed("node", "__node")
    joined = nodes.join(rooted, F.col(key) == F.col("__node"), "left").select(key, "first_id", F.coalesce("root", key).alias("root"))
    joined = cut(joined, "rooted-nodes")
    least = cut(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    return marked.join(joined.join(least, "root").select(key, "component_id"), key)


def document_classes(documents: DataFrame) -> DataFrame:
    found = classes(documents)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
