"""SimHash near-duplicates by vantage-point trees.

Fingerprints are grouped to distinct ones first, so copies cost one row.

The metric. The 64 bits are cut into PARTS parts. Each part's Hamming distance is a metric of
its own and the parts' distances add up to the whole distance, so two fingerprints within
`radius` bits are within radius // PARTS bits in at least one part. There is one
vantage-point tree for each part, searched with that smaller radius, which prunes far
better than the whole distance does; what it finds is verified by the whole distance.

Shards. The tree's upper levels are built on the driver from a bounded sample (SAMPLE
fingerprints at most, and never more than a quarter of all): a node holds a vantage point and the
median of the sample's distances from it, and fingerprints go inside or outside by their own
distance d. A leaf is a shard. Every fingerprint is a member of one shard for each part. At a
node that puts it inside, one with d + r > median also overlaps the boundary, and is sent
outside as a query; queries go to every side that the triangle bound |d(q, v) - d(x, v)| <= r
leaves open. So each near pair meets in exactly one shard for each part that finds it.

Searching. A shard's own tree goes on in the same way, at every size, with vantage points of
its own, until LEAF members are left; these are compared. A node whose members all agree in
the part goes on by the whole distance. Links feed a union-find, members within the
radius of a vantage point are linked to it at once, and a node whose rows are all of one component
already is passed over; so a dense group costs no comparison of all its pairs. A shard
returns one row for each fingerprint that isn't its own representative, never all
pairs. Components over all shards follow in Spark.

Copies: a fingerprint is one member for each part and, with s shards a part, about
0.5 * s**0.4 times a query for uniform bits and a radius of 4 (README).

Similar texts, for the pipeline (keep_one). Texts that share 0.8 of their distinct five-word shingles
differ in some 10 of 64 bits, give or take 3: too many for the above and too vague. So keep_one() takes
fingerprints of WIDE bits (signs of a Hadamard transform of signed counts of shingles), in which two texts of that
similarity differ in 155 on average, give or take 12, and unrelated ones in 512. A link is a distance of at most
WIDE_RADIUS, which 9 of 10 pairs of similarity 0.8 keep, 3 of 10 of similarity 0.75 and 1 of 40 of 0.7. As trees over all
texts would hardly prune at that radius, shards are texts that share two of LEAST_HASHES least hashes
(each the least of a text's shingles' hashes under another mixing), which two texts of similarity 0.8 fail to
do in 2 of 1000 cases, or whose fingerprints are equal. In a shard the fingerprints are
searched with a tree as above. A shard of more than WIDE_ROWS is dealt into parts by a hash, and
every two parts are a shard.

Defined cases: a null or wordless text has fingerprint 0 and is linked like any other;
fewer than four words make one shingle; repeated rows are returned each; null ids are
kept and do not count for the smallest id (a component of null ids alone has a null
component_id); an empty table gives an empty result. keep_one() keeps all rows of null ids, and of
several rows of one id, which count as one document, the one whose text comes first.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexshift.llm.graph import components
from lexshift.session import ship, staged

SHINGLE, SEED, RADIUS = 4, 42, 4
#: The parts of a fingerprint as masks: 22, 21 and 21 bits.
PARTS = tuple(np.uint64(((1 << n) - 1) << at) for at, n in ((0, 22), (22, 21), (43, 21)))
WHOLE = np.uint64((1 << 64) - 1)
SHARD_ROWS, SHARDS, SAMPLE = 65_536, 4, 20_000
LEAF = 64
WIDE, WIDE_SHINGLE, WIDE_RADIUS, WIDE_ROWS, LEAST_HASHES = 1024, 5, 170, 4096, 6
NO_ID = (1 << 63) - 1
#: Dropped ids that are broadcast at most, 8 bytes each.
BROADCAST_IDS = 4_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a whole text in UTF-8, repeats included; none for a text without words."""
    from xxhash import xxh64_intdigest as h

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text in UTF-8."""
    return of_hashes(shingle_hashes(text, shingle))


def of_hashes(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        prints = np.array([fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts], np.uint64)
        rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(prints.view(np.int64))], names=[*[batch.schema.names[i] for i in rest], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, fp): the fingerprint as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


class Links:
    """A union-find over 0..n-1 that takes arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        p = self.parent[x]
        while True:
            up = self.parent[p]
            if np.array_equal(up, p):
                return p
            p = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        self.parent = self.root(np.arange(len(self.parent)))
        return self.parent


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of fingerprints of several words, which the last axis holds."""
    bits = np.bitwise_count(a ^ b)
    return bits[..., 0] if bits.shape[-1] == 1 else bits.sum(axis=-1, dtype=np.uint16)


def _cut(distances: np.ndarray) -> int:
    """Where distances fall into two parts: the median, or the greatest value below it; -1 if all are equal."""
    cut = int(np.median(distances))
    if cut >= distances.max():
        below = distances[distances < distances.max()]
        return int(below.max()) if len(below) else -1
    return cut


@dataclass
class Shards:
    """The upper levels of a vantage-point tree over one part's bits. Children below 0 are shards: ~child is the shard's number."""

    part: np.uint64
    radius: int
    nodes: list = field(default_factory=list)  # vantage point, cut, inside, outside
    shards: int = 0

    def route(self, points: np.ndarray):
        """(shard, indices, whether they are queries there) for all points, by the rules told above."""
        stack = [(0 if self.nodes else -1, np.arange(len(points)), np.zeros(0, np.int64))]
        while stack:
            child, own, asked = stack.pop()
            if child < 0:
                yield ~child, own, False
                yield ~child, asked, True
                continue
            vantage, cut, inside, outside = self.nodes[child]
            d, e = (_distance(points[i] & self.part, vantage).astype(np.int64) for i in (own, asked))
            near = own[(d <= cut) & (d + self.radius > cut)]
            stack.append((inside, own[d <= cut], asked[e - self.radius <= cut]))
            stack.append((outside, own[d > cut], np.concatenate([asked[e + self.radius > cut], near])))


def build_shards(sample: np.ndarray, part: np.uint64, radius: int, shards: int) -> Shards:
    """A tree whose leaves hold at most 1 / shards of the sample each, as far as the vantage points can tell them apart."""
    tree, most, rng = Shards(part, radius), max(1, len(sample) // max(1, shards)), np.random.default_rng(1)
    sample = sample & part

    def grow(points: np.ndarray) -> int:
        if len(points) > most:
            tried = points[rng.choice(len(points), min(8, len(points)), replace=False)]
            spread = [_distance(points, v).astype(np.int64) for v in tried]
            best = max(range(len(tried)), key=lambda i: spread[i].var())
            cut = _cut(spread[best])
            if cut >= 0:
                at = len(tree.nodes)
                tree.nodes.append(None)
                inside = spread[best] <= cut
                tree.nodes[at] = tried[best], cut, grow(points[inside]), grow(points[~inside])
                return at
        tree.shards += 1
        return -tree.shards

    grow(sample)
    return tree


def search(points: np.ndarray, members: int, part: np.uint64, part_radius: int, radius: int, links: Links, leaf: int = LEAF) -> int:
    """Joins in `links` what the pairs within the radius join, of the first `members` points with each other and with the
    others (the queries): all pairs that part_radius in the part's bits leaves open. A point is a word or a row of
    words. Returns the tree's number of nodes."""
    points = points[:, None] if points.ndim == 1 else points
    stack, nodes = [(np.arange(members), np.arange(members, len(points)), part, part_radius)], 0
    while stack:
        own, asked, mask, r = stack.pop()
        if not len(own) or len(own) + len(asked) < 2:
            continue
        roots = links.root(np.concatenate([own, asked]))
        if (roots == roots[0]).all():
            continue
        if len(own) <= leaf:
            both = np.concatenate([own, asked])
            for at in range(0, len(both), 8192):
                i, j = np.nonzero(_apart(points[both[at : at + 8192], None], points[own][None, :]) <= radius)
                links.add(both[at + i], own[j])
            continue
        nodes += 1
        vantage = own[len(own) // 2]
        d, e = (_apart(points[i] & mask, points[vantage] & mask).astype(np.int64) for i in (own, asked))
        for some in (own, asked):  # a star about the vantage point
            near = some[_apart(points[some], points[vantage]) <= radius]
            links.add(near, np.full(len(near), vantage))
        cut = _cut(d)
        if cut >= 0:
            inside = d <= cut
            stack.append((own[~inside], np.concatenate([asked[e + r > cut], own[inside & (d + r > cut)]]), mask, r))
            stack.append((own[inside], asked[e - r <= cut], mask, r))
        elif mask != WHOLE:  # all agree in this part
            stack.append((own, asked[e <= r], WHOLE, radius))
        else:  # all are equal
            links.add(own[1:], np.full(len(own) - 1, vantage))
    return nodes


def _runs(batches, key: str):
    """Batches cut so that the rows of a key (which come one after another) are together."""
    kept = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        edge = int(change[-1]) + 1 if len(change) else 0
        if edge:
            yield pa.Table.from_batches([*kept, batch.slice(0, edge)])
            kept = [batch.slice(edge)]
        elif kept and kept[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = [batch]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def _routed(trees: list[Shards]):
    def run(batches):
        first = np.cumsum([0, *(t.shards for t in trees)])
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for base, tree in zip(first.tolist(), trees):
                for shard, some, asks in tree.route(points):
                    if len(some):
                        rows = batch.take(pa.array(some))
                        added = [pa.array(np.full(len(some), base + shard, np.int32)), pa.array(np.full(len(some), asks))]
                        yield pa.RecordBatch.from_arrays([*added, *rows.columns], names=["shard", "asks", *rows.schema.names])

    return run


def _linked(trees: list[Shards], radius: int):
    """Rows (shard, asks, fp, least) in order of shard: links of each shard as rows of two (least, fp)."""
    parts = [t for t in trees for _ in range(t.shards)]

    def run(batches):
        for rows in _runs(batches, "shard"):
            shard, asks, fp, least = (rows.column(c).to_numpy() for c in ("shard", "asks", "fp", "least"))
            firsts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist()
            for a, b in zip(firsts, [*firsts[1:], len(fp)]):
                tree, links = parts[shard[a]], Links(b - a)
                search(fp[a:b].view(np.uint64), int(np.count_nonzero(~asks[a:b])), tree.part, tree.radius, radius, links)
                roots = links.roots()
                moved = np.flatnonzero(roots != np.arange(b - a))
                columns = [pa.array(c[a:b][i]) for i in (moved, roots[moved]) for c in (least, fp)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "x", "b", "y"])

    return run


def link_edges(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """prints: distinct (fp, least). Edges (u, v), structs of least and fp, whose components are those of all links."""
    n = prints.count()
    drawn = F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 20)) < int(min(0.25, SAMPLE / max(1, n)) * (1 << 20))
    sample = prints.filter(drawn).select("fp").limit(2 * SAMPLE).toArrow().column("fp").to_numpy()
    shards = max(SHARDS, -(-n // shard_rows))
    trees = [build_shards(np.sort(sample).view(np.uint64), part, radius // len(PARTS), shards) for part in PARTS]
    routed = prints.select("fp", "least").mapInArrow(_routed(trees), "shard int, asks boolean, fp long, least long")
    shards = routed.repartitionById(sum(t.shards for t in trees), "shard").sortWithinPartitions("shard", "asks", "fp")
    found = shards.mapInArrow(_linked(trees, radius), "a long, x long, b long, y long")
    node = lambda least, fp: F.struct(F.col(least).alias("least"), F.col(fp).alias("fp"))
    return found.select(node("a", "x").alias("u"), node("b", "y").alias("v"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, text) to doc_id, fingerprint (16 hex digits), component_id."""
    prints = staged(fingerprints(docs), "fingerprints")
    # A class without an id stands behind all others.
    distinct = staged(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("least")), "distinct-fingerprints")
    roots = staged(components(link_edges(distinct, radius, shard_rows)).select(F.col("node.fp").alias("fp"), F.col("root.least").alias("root")), "roots")
    classes = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    classes = staged(classes.withColumn("component_id", F.when(F.col("component_id") != NO_ID, F.col("component_id"))), "fingerprint-classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_MIX = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Other hashes of hashes: splitmix64 of h and a salt."""
    z = h + np.uint64(salt * _MIX % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signed_counts(h: np.ndarray) -> np.ndarray:
    """Of distinct shingles' hashes: each adds 1 or -1 to one of WIDE counts."""
    z = _mixed(h, 1)
    sign = (z >> np.uint64(63)).astype(np.float32) * 2 - 1
    return np.bincount((z & np.uint64(WIDE - 1)).astype(np.int64), sign, WIDE)


def wide_fingerprints(counts: np.ndarray) -> np.ndarray:
    """Rows of signed counts to rows of words: the signs of their Hadamard transforms."""
    n, step = len(counts), 1
    x = counts.astype(np.float32)
    while step < WIDE:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return np.packbits(x.reshape(n, WIDE) > 0, axis=1, bitorder="little").view(np.uint64)


def shard_keys(h: np.ndarray) -> np.ndarray:
    """Of distinct shingles' hashes: a key for every two of the least hashes under LEAST_HASHES mixings."""
    if not len(h):
        return np.zeros(1, np.uint64)
    least = [_mixed(h, 101 + i).min() for i in range(LEAST_HASHES)]
    pairs = [(i, j) for i, j in combinations(range(LEAST_HASHES), 2)]
    one, two = (np.array([least[p[k]] for p in pairs], np.uint64) for k in (0, 1))
    return _mixed(one, 7) ^ _mixed(two + np.arange(len(pairs), dtype=np.uint64), 8)


def _sketched(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            texts = rows.column("text").cast(pa.large_binary())
            hashes = [np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", WIDE_SHINGLE)) for t in texts]
            prints = wide_fingerprints(np.stack([signed_counts(h) for h in hashes]))
            keys = [np.append(shard_keys(h), _mixed(p, 9).sum()) for h, p in zip(hashes, prints)]  # and one of equal fingerprints
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([p.tobytes() for p in prints], pa.binary()), lists], names=["doc_id", "fp", "keys"])


def _linked_wide(radius: int):
    """Rows (shard, part, least, fp) in order of shard and part: links of each shard as rows of two ids."""

    def run(batches):
        for rows in _runs(batches, "shard"):
            shard, part, least = (rows.column(c).to_numpy() for c in ("shard", "part", "least"))
            points = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(len(least), -1)
            links = Links(len(least))
            firsts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            sizes = np.diff([*firsts, len(least)])
            at = np.flatnonzero(np.repeat((sizes <= 16) & (sizes > 1), sizes))
            for step in range(1, 16):  # small shards are leaves: neighbours at each step, for all shards at once
                at = at[at + step < len(least)]
                at = at[shard[at] == shard[at + step]]
                near = at[_apart(points[at], points[at + step]) <= radius]
                links.add(near, near + step)
            for a, n in zip(firsts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
                members = int(np.searchsorted(part[a : a + n], part[a], "right"))  # of two parts; the second's own pairs are another shard's
                own = Links(n)
                search(points[a : a + n], members, WHOLE, radius, radius, own)
                roots = own.roots()
                moved = np.flatnonzero(roots != np.arange(n))
                links.add(a + moved, a + roots[moved])
            roots = links.roots()
            moved = np.flatnonzero(roots != np.arange(len(least)))
            yield pa.RecordBatch.from_arrays([pa.array(least[moved]), pa.array(least[roots[moved]])], names=["u", "v"])

    return run


def similar_edges(sketches: DataFrame, radius: int = WIDE_RADIUS, shard_rows: int = WIDE_ROWS) -> DataFrame:
    """sketches: (least, fp, keys). Edges (u, v) between the ids `least` whose components are those of all links."""
    dealt = sketches.select("least", F.explode(F.array_distinct("keys")).alias("key"))
    parts = F.ceil(F.col("count") / shard_rows).cast("long").alias("parts")
    sizes = staged(dealt.groupBy("key").count().filter("count > 1").select("key", parts), "shared-keys")
    own = F.pmod(F.xxhash64("least"), F.col("parts"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.struct(F.least("own", j).alias("a"), F.greatest("own", j).alias("b")))
    rows = dealt.join(sizes, "key").withColumn("own", own).withColumn("pair", F.explode(others))
    rows = staged(rows.select(F.xxhash64("key", "pair.a", "pair.b").alias("shard"), F.col("own").alias("part"), "least"), "shared-shards")
    rows = rows.join(sketches.select("least", "fp"), "least")
    return rows.repartition("shard").sortWithinPartitions("shard", "part", "least").mapInArrow(_linked_wide(radius), "u long, v long")


def keep_one(docs: DataFrame, radius: int = WIDE_RADIUS, shard_rows: int = WIDE_ROWS) -> DataFrame:
    """The documents that stay: of each component of similar texts the one of the smallest id, once, and all without an id."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = staged(rows.mapInArrow(_sketched, "doc_id long, fp binary, keys array<long>"), "sketches")
    distinct = sketches.groupBy("fp", "keys").agg(F.min("doc_id").alias("id"))  # texts of null ids alone stand behind all others
    least = F.coalesce("id", F.lit(NO_ID) - F.monotonically_increasing_id()).alias("least")
    distinct = staged(distinct.select(least, "fp", "keys"), "distinct-sketches")
    roots = components(similar_edges(distinct, radius, shard_rows)).filter("node <> root").select(F.col("node").alias("least"))
    kept = distinct.select("least").distinct().join(roots, "least", "left_anti").withColumnRenamed("least", "doc_id")
    gone = staged(sketches.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(kept, "doc_id", "left_anti"), "dropped-ids")
    # Ids up to a checked number are broadcast, so that no text is shuffled; beyond it the join is left to Spark.
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    if sketches.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").head(1):
        order = W.Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
        first = left.filter("doc_id IS NOT NULL").withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
        left = first.unionByName(left.filter("doc_id IS NULL"))
    return left
