"""SimHash near-duplicates through vantage-point trees (operator 10).

Fingerprints are taken once per document and grouped, so that a group of copies is one point. ``Tree`` parts the space
of fingerprints by their Hamming distance to vantage points: at every inner node a ball around one point, half of them inside.
A bounded sample chooses vantage points and borders, which decides the sizes of shards and nothing else. A point's home
is one shard. By the triangle inequality two points within ``radius`` have distances to a vantage point that differ by
``radius`` at most, so a point inside a ball that is within ``radius`` of its border also visits the shards
outside, and a visitor goes on to every side that its bound allows: each near pair meets in exactly one shard. A shard that holds more than
``BLOCK`` rows is dealt out as pairs of hashed blocks. Inside a shard vantage-point trees with the same bounds find the links between
its own points and to its visitors. A shard sends on a spanning forest of its links, at most one row per point, never its
pairs. Forests of all shards join in ``components``.

``deduplicate`` with ``share`` links documents whose sets of shingles have at least that Jaccard similarity (0.8 in the pipeline), exactly. Such sets
are found in two steps. Candidates are documents that agree in one of ``BANDS`` keys of ``ROWS`` minimum hashes each and
whose 256-bit fingerprints of distinct shingles differ in no more than ``LOOSE`` bits; at a similarity of 0.8 a pair misses all
keys with a chance of 2 in 10,000 and the fingerprints with one below 1 in 10 million. Components of candidates are loose groups: each brings its sets together once, dealt
out as pairs of blocks of bounded size, and only pairs whose sets, compared in full, reach the share are links (``confirmed``). So no document goes that isn't
that similar to another one of its component. Sets are known by 64-bit hashes of shingles.

Null texts are empty; a document without words has fingerprint 0 and is linked like any other. Documents of
fewer than ``width`` words are one shingle. Repeated rows fall on one point. Rows without an id are linked too, but name a component only
where no row has an id: its component_id is null then. Rows that share an id, but not the text, are rows of their own. ``deduplicate`` leaves one
row of each component, the one with the least id (rows without an id last; of equal ones any), with all columns, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, batch, byte_texts, fresh_name, lower_ascii, mix64, quoted, ready, shuffle_parts, stored, tidy, with_small, words_of
from .components import components

WIDTH, SEED, RADIUS = 4, 42, 4
#: Points compared outright; home points of a shard; sampled points per shard; least and most shards; rows of a shard that one task takes.
LEAF, SHARD, PER_SHARD, LEAST_SHARDS, MOST_SHARDS, BLOCK = 256, 1 << 15, 32, 32, 1 << 14, 1 << 20
#: Linking by similarity: 64-bit words of a fingerprint; keys, and minimum hashes of each; bits that candidates differ in at most (the distance at a similarity
#: of 0.8 has mean 39 and deviation 6); sets of fewer shingles are candidates by their keys alone, as their fingerprints are too coarse.
WIDE, BANDS, ROWS, LOOSE, FEW = 4, 12, 3, 70, 80
#: Candidates of a key that one task takes; bytes of sets of a block; sets of a tile, and columns of the matrix that compares two tiles.
KEY_BLOCK, SET_BYTES, TILE, COLUMNS = 1 << 14, 32 << 20, 256, 4096


# ---- fingerprints -------------------------------------------------------------------------


def shingle_hashes(text: bytes, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; none for a text without words."""
    words = words_of(lower_ascii(text))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> bytes:
    """The 64 bits that more than half of the hashes set, big-endian."""
    if not len(hashes):
        return bytes(8)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * set_bits > len(hashes)).tobytes()


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    return int.from_bytes(majority(shingle_hashes(text, width, seed)), "big")


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE) -> bytes:
    """``words`` times 64 bits from independent mixtures of the hashes."""
    return b"".join(majority(mix64(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))) for k in range(words)) if len(hashes) else bytes(8 * words)


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in byte_texts(b.column(1))], np.uint64)
            yield batch(schema, b.column(0), fps.view(np.int64))

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


# ---- links within a shard -----------------------------------------------------------------


class Forest:
    """Union-find over points 0..n-1 that takes whole matrices of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while True:
            up = self.parent[found]
            if (up == found).all():
                self.parent[at] = found
                return found
            found = up

    def link(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
        """Join a[i] and b[j] wherever near[i, j]."""
        if not near.any():
            return
        rows, cols = near.any(1), near.any(0)
        a, b, near = a[rows], b[cols], near[np.ix_(rows, cols)]
        old_a, old_b = self.roots(a), self.roots(b)
        new_a, new_b = old_a.copy(), old_b.copy()
        top = np.int64(len(self.parent))
        while True:
            to_a = np.minimum(new_a, np.where(near, new_b[None, :], top).min(1))
            to_b = np.minimum(new_b, np.where(near, to_a[:, None], top).min(0))
            if (to_a == new_a).all() and (to_b == new_b).all():
                break
            new_a, new_b = to_a, to_b
        for old, new in ((old_a, new_a), (old_b, new_b)):
            for x, y in {(x, y) for x, y in zip(old.tolist(), new.tolist(), strict=True) if x != y}:
                self._join(x, y)

    def _root(self, x: int) -> int:
        while (p := int(self.parent[x])) != x:
            self.parent[x] = self.parent[p]
            x = p
        return x

    def _join(self, x: int, y: int) -> None:
        x, y = self._root(x), self._root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    """Hamming distances of points (rows of 64-bit words) to one point."""
    return np.bitwise_count(points ^ vantage).sum(1, dtype=np.int16)


def _compare(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    if len(np.unique(np.concatenate([forest.roots(a), forest.roots(b)]))) == 1:
        return  # linked already
    for k in range(0, len(a), 512):
        for m in range(0, len(b), 512):
            i, j = a[k : k + 512], b[m : m + 512]
            far = np.bitwise_count(points[i, 0][:, None] ^ points[j, 0][None, :]).astype(np.uint16 if points.shape[1] > 3 else np.uint8)
            for w in range(1, points.shape[1]):
                far += np.bitwise_count(points[i, w][:, None] ^ points[j, w][None, :])
            forest.link(i, j, far <= radius)


def _across(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """Links between points a and points b."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= LEAF * LEAF:
            _compare(points, a, b, radius, forest)
            continue
        vantage = points[(a if len(a) >= len(b) else b)[0]]
        da, db = distances(points[a], vantage), distances(points[b], vantage)
        border = int(np.median(np.concatenate([da, db])))
        parts = [
            (a[da <= border], b[db <= border + radius]),
            (a[da > border], b[db > border - radius]),
        ]
        work = sum(len(x) * len(y) for x, y in parts)
        if work > 0.9 * len(a) * len(b):
            _compare(points, a, b, radius, forest)
        else:
            todo += parts


def _within(points: np.ndarray, at: np.ndarray, radius: int, forest: Forest) -> None:
    """Links among the points ``at``."""
    todo = [at]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            if len(at) > 1:
                _compare(points, at, at, radius, forest)
            continue
        distance = distances(points[at], points[at[0]])
        border = int(np.median(distance))
        inside = distance <= border
        if inside.all():
            inside = distance < border
        if not inside.any():  # all at one distance of the vantage point, which is itself among them
            _compare(points, at, at, radius, forest)
            continue
        edge = border if (distance[inside] == border).any() else border - 1
        todo += [at[inside], at[~inside]]
        _across(points, at[inside & (distance > edge - radius)], at[~inside & (distance <= edge + radius)], radius, forest)


def tree_links(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For every point (distinct uint64, or rows of them) the first point of its component under links of at most
    ``radius`` bits, found with a vantage-point tree."""
    points = points.reshape(len(points), -1)
    forest = Forest(len(points))
    _within(points, np.arange(len(points)), radius, forest)
    return forest.roots(np.arange(len(points)))


# ---- the top level ------------------------------------------------------------------------


class Tree:
    """A vantage-point tree over 64-bit fingerprints whose leaves are shards."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int):
        self.radius = radius
        #: (vantage point, border, child inside, child outside); a negative child is a shard
        self.nodes: list[tuple[int, int, int, int]] = []
        self.shards = 0
        self.root = self._grow(np.sort(sample), max(1, shards))

    def _grow(self, sample: np.ndarray, shards: int) -> int:
        best = None
        if shards > 1 and len(sample) >= 8:
            for vantage in sample[:: max(1, len(sample) // 6)][:6]:
                d = np.bitwise_count(sample ^ vantage).astype(np.int16)
                border = int(np.median(d))
                inside = int((d <= border).sum())
                shell = int((np.abs(d - border) <= self.radius).sum())
                if 0 < inside < len(sample) and (best is None or shell < best[0]):
                    best = (shell, int(vantage), border, d)
        if best is None:
            self.shards += 1
            return -self.shards
        _, vantage, border, d = best
        at = len(self.nodes)
        self.nodes.append((0, 0, 0, 0))
        inside = self._grow(sample[d <= border], shards - shards // 2)
        self.nodes[at] = (vantage, border, inside, self._grow(sample[d > border], shards // 2))
        return at

    def route(self, points: np.ndarray):
        """(shard, places of its own points, places of its visitors) for every shard that has any."""
        none = np.zeros(0, np.int64)
        todo = [(self.root, np.arange(len(points)), none)]
        while todo:
            node, own, visiting = todo.pop()
            if not len(own) and not len(visiting):
                continue
            if node < 0:
                yield -node - 1, own, visiting
                continue
            vantage, border, inside, outside = self.nodes[node]
            d_own = np.bitwise_count(points[own] ^ np.uint64(vantage)).astype(np.int16)
            d_visiting = np.bitwise_count(points[visiting] ^ np.uint64(vantage)).astype(np.int16)
            crossing = own[(d_own <= border) & (d_own > border - self.radius)]
            todo.append((inside, own[d_own <= border], visiting[d_visiting <= border + self.radius]))
            todo.append((outside, own[d_own > border], np.concatenate([visiting[d_visiting > border - self.radius], crossing])))


def tree(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> Tree:
    """A tree for (fp long) points: ``LEAST_SHARDS``, or as many shards of about ``shard`` points as there are. Every doubling of their
    number makes some 1.6 times as many visits, which is why there are no more.
    The sample that reaches the driver has at most one point in eight and some ``PER_SHARD`` times ``MOST_SHARDS`` points."""
    n = points.count()
    shards = min(max(-(-n // shard), min(LEAST_SHARDS, n // 128)), MOST_SHARDS)
    if shards < 2:
        return Tree(np.zeros(0, np.uint64), 1, radius)
    every = max(8, n // (PER_SHARD * shards))
    rows = points.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").collect()
    return Tree(np.array([r[0] for r in rows], np.int64).view(np.uint64), shards, radius)


_MET = pa.schema([("key", pa.int64()), ("own", pa.bool_()), ("node", pa.int64()), ("fp", pa.binary())])
_MET_DDL = "key long, own boolean, node long, fp binary"


def _packed(points: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as a binary column."""
    width = 8 * points.shape[1]
    offsets = pa.array(np.arange(0, width * len(points) + 1, width), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(points), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(points).tobytes())])


def _unpacked(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(len(column), -1)


def shard_rows(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(key, own, node, fp): every point (fp long, distinct) in its home shard and in those that it visits."""
    top = tree(points, radius, shard)

    def run(batches):
        for b in batches:
            fps = np.asarray(b.column(0)).view(np.uint64)
            for shard_, own, visiting in top.route(fps):
                at = np.concatenate([own, visiting])
                home = np.arange(len(at)) < len(own)
                yield batch(_MET, np.full(len(at), shard_), home, fps[at].view(np.int64), _packed(fps[at][:, None]))

    return ready(points).select("fp").mapInArrow(tidy(run), _MET_DDL)


def meet(rows: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(u, v) links between nodes that span the near pairs among each key's own rows and between these and the key's other rows.
    ``rows`` (key, own, node, fp) is read twice and should be a stored table."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    split = sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("s"))
    place = F.pmod(F.xxhash64("node"), F.col("s")).cast("int")
    # a large key is dealt out as pairs of blocks; other keys are block 0 with itself
    mine = rows.join(split, "key", "left").withColumns({"s": F.coalesce("s", F.lit(1)), "mine": F.coalesce(place, F.lit(0))})
    dealt = mine.select("key", "own", "node", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other"))
    dealt = dealt.select("key", "own", "node", "fp", "mine", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        parts = []
        for b in batches:
            if b.num_rows:
                parts.append((*(np.asarray(b.column(k)) for k in (0, 4, 5, 6, 2)), b.column(1).to_numpy(zero_copy_only=False), _unpacked(b.column(3))))
        if not parts:
            return
        key, mine, a, b, node, own, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((node, b, a, key))
        key, mine, a, b, node, own, fp = (x[order] for x in (key, mine, a, b, node, own, fp))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if j - i < 2:
                continue
            points, home, first = fp[i:j], own[i:j], mine[i:j] == a[i]
            forest = Forest(j - i)
            if a[i] == b[i]:
                _within(points, np.flatnonzero(home), radius, forest)
                _across(points, np.flatnonzero(home), np.flatnonzero(~home), radius, forest)
            else:
                _across(points, np.flatnonzero(home & first), np.flatnonzero(~first), radius, forest)
                _across(points, np.flatnonzero(~home & first), np.flatnonzero(home & ~first), radius, forest)
            root = forest.roots(np.arange(j - i))
            moved = np.flatnonzero(root != np.arange(j - i))
            yield batch(schema, node[i:j][moved], node[i:j][root[moved]])

    parts = 2 * shuffle_parts(rows.sparkSession)
    return dealt.repartition(parts, "key", "a", "b").mapInArrow(tidy(run), "u long, v long")


def links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(u, v) links between fingerprints that span the components of ``points`` (fp long, distinct)."""
    return meet(stored(shard_rows(points, radius, shard), "shards"), radius, block)


# ---- groups of documents ------------------------------------------------------------------


def _named(points: DataFrame, found: DataFrame, node: str, value: str) -> DataFrame:
    """``points`` with ``value`` the least of its component by ``found`` (links between nodes)."""
    labels = points.join(components(found), F.col(node) == F.col("id"), "left").select(*points.columns, F.coalesce("component_id", node).alias("_label"))
    least = labels.groupBy("_label").agg(F.min(value).alias("_least"))
    return labels.join(least, "_label").drop("_label")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = stored(fingerprints(docs), "fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    # stored, so that the last join stands alone and adaptive execution can split a common fingerprint
    named = stored(_named(points, links(points, radius, shard, block), "fp", "rep").select("fp", F.col("_least").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- groups of documents by the similarity of their sets ----------------------------------

_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of hashes, each of ``ROWS`` minimum hashes; none for no shingle."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[k : k + 4096, None] * _FACTORS).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) ^ row)
    return keys


def _tagged(docs: DataFrame, width: int, exact: bool, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with the key of their content (the fingerprint, or with ``exact`` a hash of the set of shingles), the fingerprint, the number of distinct shingles and the
    keys of ``band_keys`` (none without ``exact``)."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            rows = []
            for t in byte_texts(b.column(at)):
                h = shingle_hashes(t, width)
                if exact:
                    h = np.unique(h)
                    rows.append((xxhash.xxh3_128_digest(h.tobytes()), wide_fingerprint(h), len(h), band_keys(h).view(np.int64)))
                else:
                    m = majority(h)
                    rows.append((m, m, len(h), []))
            key, fp, n, keys = zip(*rows, strict=True) if rows else ((),) * 4
            more = pa.array(key, pa.binary()), pa.array(fp, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    added = zip(names, (T.BinaryType(), T.BinaryType(), T.LongType(), T.ArrayType(T.LongType())), strict=True)
    return ready(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added)]))


_SETS = pa.schema([("label", pa.int64()), ("node", pa.int64()), ("fp", pa.binary()), ("members", pa.binary())])
_SETS_DDL = "label long, node long, fp binary, members binary"


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(label, node, fp, members) of (label, node, fp, text): the sorted set, packed."""

    def run(batches):
        for b in batches:
            yield batch(_SETS, b.column(0), b.column(1), b.column(2), [np.unique(shingle_hashes(t, width)).tobytes() for t in byte_texts(b.column(3))])

    return texts.mapInArrow(tidy(run), _SETS_DDL)


def similar_pairs(fps: np.ndarray, sets: list[np.ndarray], first: np.ndarray, share: Fraction, forest: Forest) -> None:
    """Link all sets that share ``share`` of what either has: of pairs with one ``first`` and one other, or of all pairs where ``first`` is true everywhere. Pairs that are
    linked already, or whose sizes or fingerprints rule it out, are not compared. Tiles with many pairs are compared by one product of incidence matrices."""
    top, base = share.numerator, share.denominator
    size = np.array([len(x) for x in sets], np.int64)
    every, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a shingle of one set only is in no intersection
    number = np.cumsum(often > 1) - 1
    edges = np.concatenate([[0], np.cumsum(size)])
    columns = [number[c[often[c] > 1]] for c in (column[a:b] for a, b in zip(edges, edges[1:], strict=False))]
    total = int((often > 1).sum())
    del every, column, number
    one, other = np.flatnonzero(first), np.flatnonzero(~first)
    within = not len(other)
    other = one if within else other
    one, other = one[np.argsort(size[one], kind="stable")], other[np.argsort(size[other], kind="stable")]

    def dense(rows: np.ndarray, low: int, wide: int) -> np.ndarray:
        out = np.zeros((len(rows), wide), np.float32)
        for k, r in enumerate(rows.tolist()):
            a, b = np.searchsorted(columns[r], [low, low + wide])
            out[k, columns[r][a:b] - low] = 1
        return out

    for k in range(0, len(one), TILE):
        for m in range(k if within else 0, len(other), TILE):
            i, j = one[k : k + TILE], other[m : m + TILE]
            maybe = forest.roots(i)[:, None] != forest.roots(j)[None, :]
            maybe &= (np.minimum(size[i][:, None], size[j]) * base >= np.maximum(size[i][:, None], size[j]) * top) & (size[i] > 0)[:, None]
            if not maybe.any():
                continue
            far = np.zeros(maybe.shape, np.uint16)
            for w in range(fps.shape[1]):
                far += np.bitwise_count(fps[i, w][:, None] ^ fps[j, w][None, :])
            maybe &= (far <= LOOSE) | (np.minimum(size[i][:, None], size[j]) < FEW)
            rows, cols = maybe.any(1), maybe.any(0)
            i, j, maybe = i[rows], j[cols], maybe[np.ix_(rows, cols)]
            if maybe.sum() <= 4 * (len(i) + len(j)):
                for x, y in np.argwhere(maybe).tolist():
                    x, y = int(i[x]), int(j[y])
                    if forest._root(x) != forest._root(y):
                        both = len(np.intersect1d(columns[x], columns[y], assume_unique=True))
                        if both * base >= top * (size[x] + size[y] - both):
                            forest._join(x, y)
                continue
            both = np.zeros(maybe.shape, np.float64)
            for low in range(0, total, COLUMNS):
                both += dense(i, low, min(COLUMNS, total - low)) @ dense(j, low, min(COLUMNS, total - low)).T
            both = np.rint(both).astype(np.int64)
            forest.link(i, j, maybe & (both * base >= top * (size[i][:, None] + size[j] - both)))


def confirmed(sets: DataFrame, share: Fraction, set_bytes: int = SET_BYTES) -> DataFrame:
    """(u, v) links between nodes of ``sets`` (label, node, fp, members; stored) that span, within each label, the components of sets with at least ``share`` in common."""
    sizes = sets.groupBy("label").agg(F.sum(F.octet_length("members")).alias("bytes")).where(F.col("bytes") > set_bytes)
    split = stored(sizes.select("label", F.ceil(F.col("bytes") / set_bytes).cast("int").alias("s")), "large")
    mine = with_small(sets, split, "label", "node").withColumn("s", F.coalesce("s", F.lit(1)))
    mine = mine.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("label", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "node", "mine", "fp", "members")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def group(key: tuple, rows: list[tuple]):
        if len(rows) < 2:
            return
        rows.sort(key=lambda r: r[0])
        nodes, first = np.array([r[0] for r in rows], np.int64), np.array([r[1] == key[1] for r in rows])
        if key[1] != key[2] and first.all():
            return
        forest = Forest(len(rows))
        similar_pairs(np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(len(rows), -1), [np.frombuffer(r[3], np.uint64) for r in rows], first, share, forest)
        root = forest.roots(np.arange(len(rows)))
        moved = np.flatnonzero(root != np.arange(len(rows)))
        yield batch(schema, nodes[moved], nodes[root[moved]])

    def run(batches):
        key, rows = None, []
        for b in batches:
            for label, a, c, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if key != (label, a, c):
                    yield from group(key, rows)
                    key, rows = (label, a, c), []
                rows.append(row)
        yield from group(key, rows)

    parts = dealt.repartition(2 * shuffle_parts(sets.sparkSession), "label", "a", "b").sortWithinPartitions("label", "a", "b")
    return parts.mapInArrow(tidy(run), "u long, v long")


def _similar(tagged: DataFrame, points: DataFrame, names: tuple[str, ...], row: str, width: int, share: float, key_block: int, set_bytes: int) -> DataFrame:
    """(u, v) confirmed links between ``points`` (node, fp, n, keys)."""
    few = F.col("n") < FEW
    keyed = points.select(F.explode("keys").alias("key"), "node", "fp", few.alias("few"))
    zero = F.unhex(F.lit("00" * 8 * WIDE))
    # few shingles: also under a key of their own, where fingerprints don't count
    alike = keyed.where("few").select(F.bitwise_not("key").alias("key"), F.lit(True).alias("own"), "node", zero.alias("fp"))
    rows = stored(keyed.select("key", F.lit(True).alias("own"), "node", "fp").unionByName(alike), "keys")
    loose = stored(components(meet(rows, LOOSE, key_block)).select("id", F.col("component_id").alias("label")), "loose")
    # every id but the least of a component has a row
    members = loose.unionByName(loose.select(F.col("label").alias("id"), "label").distinct()).distinct()
    text = tagged.select(F.col(row).alias("node"), F.col(names[1]).alias("fp"), "text")
    met = text.join(F.broadcast(members) if loose.count() <= BROADCAST_ROWS // 2 else members, F.col("node") == F.col("id"))
    sets = stored(_sets(met.select("label", "node", "fp", "text"), width), "sets")
    return confirmed(sets, Fraction(share).limit_denominator(1000), set_bytes)


def deduplicate(
    docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, share: float | None = None, block: int = BLOCK, key_block: int = KEY_BLOCK, set_bytes: int = SET_BYTES
) -> DataFrame:
    """One row of ``docs`` for every component, with all its columns: components of fingerprints within ``radius`` or, if ``share`` is
    given, of documents whose sets of shingles have that Jaccard similarity or more."""
    row, keep, *names = (fresh_name(docs, n) for n in ("row", "keep", "key", "fp", "n", "keys"))
    tagged = stored(_tagged(docs, width, share is not None, tuple(names)).withColumn(row, F.monotonically_increasing_id()), "tagged")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row")).alias("rank")
    firsts = tagged.groupBy(names[0]).agg(F.min(rank).alias("rank"), *(F.first(n).alias(c) for n, c in zip(names[1:], ("fp", "n", "keys"), strict=True)))
    if share is None:
        fp = F.conv(F.hex(names[0]), 16, -10).cast("long")
        points = stored(firsts.select(fp.alias("node"), "rank"), "points")
        found = links(points.select(F.col("node").alias("fp")), radius, block=block)
    else:
        points = stored(firsts.select(F.col("rank.row").alias("node"), "rank", "fp", "n", "keys"), "points")
        found = _similar(tagged, points, tuple(names), row, width, share, key_block, set_bytes)
    kept = _named(points.select("node", "rank"), found, "node", "rank").where(F.col("rank") == F.col("_least")).select(F.col("rank.row").alias(keep))
    return tagged.join(kept, F.col(row) == F.col(keep), "left_semi").select(*(F.col(quoted(c)) for c in docs.columns))
