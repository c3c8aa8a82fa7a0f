"""Near duplicates by MinHash and an LSH forest.

1. A text's set of word shingles gets TREES * BASE minwise hashes.  Texts with
   the same set are one node from here on, whatever their number.
2. The forest is TREES sorted orders of the nodes.  A tree's order begins with
   BASE hashes of its own and goes on with those of other trees; nodes with the
   same first BASE hashes are a region, and neighbours in the order are those
   with the longest common prefixes, so a region is looked at as deep as it is
   dense.  A node is compared with the nodes one and two before it and with the
   region's first, by two bits of each minwise hash, inside the task that holds
   the order.  Those that agree in LOOSE of them join nodes to families; edges
   that join what is joined already are not emitted, so edges grow with the
   nodes, not with the square of a region.
3. Neighbours that may have the similarity (their bits don't rule it out by 6.5
   standard deviations) are compared on their full sets and give the first
   components, which most copies of a group are in.
4. In families of more than one component all pairs of different components
   are compared, whatever the family's size.  A family is dealt into parts of
   about BLOCK sets and at most about SHINGLES shingles; a task has the sets of
   two parts, multiplies their incidence matrix and gives back the links that
   join something, so no pair becomes a row.  A family of more than PARTS parts
   would send each set too often; there, with a set's shingles in order of how
   many sets of these families have them, rarest first, two sets of the
   similarity share one of the first n - ceil(n * percent / 100) + 1, so that
   only sets that share one are compared, again in blocks, first by the bits (6.5
   standard deviations), then on their full sets.  Both ways are exact.

A pair at the threshold of 85 % is in one region of some tree but for a chance
of (1 - 0.85**BASE)**TREES, about 2e-8, and in 12 of them on average; it is in
one family if in any of these trees the nodes between the two, which have as
long a common prefix with both, agree loosely.  Inside a family no pair is left
out but by the bits' 6.5 standard deviations.

Sizes: rows of the forest are ranged over tasks by the whole order, so a region
that holds much of the corpus is many tasks' work; comparisons are dealt by
component and salted; components are joined by tasks of EDGES edges each;
counts by set are pre-aggregated.  Prefix search works on
a shingle's sets only while they are of several components, and in as many
tasks as it has pairs of blocks; the order of shingles needs BUCKETS counts,
whatever the corpus, and any order gives the same pairs.

Nulls and empty texts have no shingles and are linked with nothing; a null
doc_id can't be a component's id unless all of its texts have none.  Texts with
fewer words than a shingle have one shingle of all their words.  Very long texts
are worked on one at a time, whole.  Repeated rows are in one component each
with the others; of rows with equal id and text `one_of_each` keeps the one that
comes first as JSON.  An empty table gives an empty result.  Other columns,
of whatever name, are not read, but for `one_of_each`, which keeps them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import LOWER, Words, grams, pieces

TREES, BASE, DEPTH = 24, 4, 12
#: Equal pairs of bits, of TREES * BASE, that join nodes to a family; a quarter agree by chance.
LOOSE = 45
UNIT_PAIRS = 4000
BUCKETS, BLOCK = 1 << 20, 512
#: Shingles in a part of a family, parts up to which all pairs of parts are compared, and sets that are compared pair by pair.
SHINGLES, PARTS, SMALL = 1_500_000, 32, 24
#: Edges that a task joins at once.
EDGES = 250_000
_U = np.uint64


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9176)
    a = rng.integers(0, 2**63, TREES * BASE, dtype=np.int64).astype(_U)
    b = rng.integers(0, 2**63, TREES * BASE, dtype=np.int64).astype(_U)
    return a, b * _U(2) + _U(1)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text."""
    out = []
    for lo, hi in pieces(texts):
        w = Words(texts[lo:hi], LOWER)
        g = grams(w.hash, k)
        for a, b in zip(w.first.tolist(), w.first[1:].tolist(), strict=False):
            out.append(np.unique(g[a : b - k + 1]) if b - a >= k else grams(w.hash[a:b], b - a) if b > a else np.zeros(0, _U))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Row of 16-bit minwise hashes for each set that is not empty."""
    from .words import mix

    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.int64)
    out = np.empty((len(sets), TREES * BASE), np.uint16)
    for i, (a, b) in enumerate(zip(*_constants(), strict=True)):
        out[:, i] = (mix(np.minimum.reduceat((every ^ a) * b, starts)) >> _U(48)).astype(np.uint16)
    return out


def _tree_order() -> list[list[int]]:
    """Places in the signature of each tree's order: its own hashes, then those of others."""
    out = []
    for t in range(TREES):
        trees = [t, *((t + 5 * j + 1) % TREES for j in range(1, TREES))]
        seen = dict.fromkeys(x for x in trees)
        out.append([BASE * x + i for x in seen for i in range(BASE)][:DEPTH])
    return out


def scan(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table: uid, doc_id, node (hash of the set, null if empty), n, signature, packed text, hash of the text."""
    schema = "uid long, doc_id long, node binary, n long, signature binary, packed binary, said binary"
    want = shared.arrow_schema(docs.sparkSession, schema)

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts, keys = shared.texts(batch), batch.column("doc_id")
            for lo, hi in pieces(texts):
                sets = shingle_sets(texts[lo:hi], k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                        sig[i] = row.astype(">u2").tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "uid": np.arange(uid, uid + hi - lo),
                        "doc_id": keys[lo:hi],
                        "node": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        "n": [len(s) for s in sets],
                        "signature": sig,
                        "packed": [press.compress(t) for t in texts[lo:hi]],
                        "said": [hashlib.md5(t).digest() for t in texts[lo:hi]],
                    },
                    schema=want,
                )
                uid += hi - lo

    return shared.written(shared.keyed(docs, key, text).mapInArrow(run, schema), "signatures")


def bits_of(signature: np.ndarray) -> np.ndarray:
    """Two bits of each hash of some signatures: rows of packed low bits and then high bits."""
    return np.concatenate([np.packbits(signature & 1, axis=1), np.packbits(signature >> 1 & 1, axis=1)], axis=1)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many hashes the bits of two lists of nodes differ."""
    far, half = x ^ y, x.shape[-1] // 2
    return np.bitwise_count(far[..., :half] | far[..., half:]).sum(-1, dtype=np.int64)


def most_apart(percent: int) -> int:
    """Differing pairs of bits above which a similarity of so many percent is ruled out."""
    n, share = TREES * BASE, percent / 100
    same = share + (1 - share) / 4
    return n - max(0, math.floor(n * same - 6.5 * math.sqrt(n * same * (1 - same))))


def forest(nodes: DataFrame, percent: int) -> DataFrame:
    """A written table of edges (a, b, near) between nodes that agree loosely; near if they may have the similarity."""
    orders = _tree_order()
    near_by = most_apart(percent)

    def out(batch):
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u2").reshape(batch.num_rows, -1)
        bits = [x.tobytes() for x in bits_of(sig)]
        for t in range(TREES):
            place = np.ascontiguousarray(sig[:, orders[t]]).view(f"S{2 * DEPTH}").ravel()
            flat = place.tobytes()
            yield {"tree": np.full(batch.num_rows, t), "place": [flat[i : i + 2 * DEPTH] for i in range(0, len(flat), 2 * DEPTH)], "uid": batch.column("uid"), "n": batch.column("n"), "bits": bits}

    rows = shared.arrow(nodes.select("uid", "n", "signature"), out, "tree int, place binary, uid long, n long, bits binary")
    schema = "a long, b long, near boolean"
    want = shared.arrow_schema(nodes.sparkSession, schema)
    cut = 2 * BASE

    def walk(batches):
        # what is carried from batch to batch: the region's first node and the last two
        region, held = b"", None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            tree = batch.column("tree").to_numpy().astype(">u4").view(np.uint8).reshape(size, -1)
            place = np.frombuffer(b"".join(batch.column("place").to_pylist()), np.uint8).reshape(size, -1)[:, :cut]
            name = np.ascontiguousarray(np.concatenate([tree, place], axis=1)).view(f"V{4 + cut}").ravel()
            uid, n = batch.column("uid").to_numpy(), batch.column("n").to_numpy()
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(size, -1)
            before = 0
            if held is not None and name[0].tobytes() == region:
                before = len(held[0])
                uid, n, bits = (np.concatenate([x, y]) for x, y in zip(held, (uid, n, bits), strict=True))
            new = np.ones(size, bool)
            new[1:] = name[1:] != name[:-1]
            new[0] = not before
            fresh = np.concatenate([np.zeros(before, bool), new])
            if before:
                fresh[0] = True
            at = np.arange(len(uid))
            first = np.maximum.accumulate(np.where(fresh, at, 0))
            some = at[(at >= before) & (at > first)]
            one, two, lead = some - 1, np.maximum(some - 2, first[some]), first[some]
            far = [apart(bits[some], bits[x]) for x in (one, two, lead)]
            loose = [f <= TREES * BASE - LOOSE for f in far]
            # a second edge is of use only where the first one is not there or doesn't lead on
            step = np.zeros(len(uid), bool)
            step[some] = loose[0]
            led = step[one] & loose[0]
            breaks = np.cumsum(~step & ~fresh)
            chained = breaks[some] == breaks[lead]
            use = [loose[0], loose[1] & ~led & (two < one), loose[2] & ~chained & (lead < two)]
            sized = 100 * np.minimum(n[some], n[one]) >= percent * np.maximum(n[some], n[one])
            near = [sized & (far[0] <= near_by), np.zeros(len(some), bool), np.zeros(len(some), bool)]
            a = np.concatenate([uid[some][u] for u in use])
            b = np.concatenate([uid[x][u] for x, u in zip((one, two, lead), use, strict=True)])
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "near": np.concatenate([x[u] for x, u in zip(near, use, strict=True)])}, schema=want)
            region = name[-1].tobytes()
            keep = sorted({int(first[-1]), max(int(first[-1]), len(uid) - 2), len(uid) - 1})
            held = (uid[keep], n[keep], bits[keep])

    order = ["tree", "place", "uid"]
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    made = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(walk, schema)
    return shared.written(made.groupBy("a", "b").agg(F.max("near").alias("near")), "forest")


def _mates(live: DataFrame, turn: int) -> DataFrame:
    """(u, p) of every end of an edge: its neighbour, or itself, that comes first in the turn's hashed order."""
    first = lambda c: F.xxhash64(c, F.lit(turn))
    both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min_by("v", first("v")).alias("v"))
    return least.select("u", F.when(first("u") < first("v"), F.col("u")).otherwise(F.col("v")).alias("p"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their least fellow) of the components of some edges, but for the least ones themselves."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        p, q = root[x], root[y]
        if not (open_ := p != q).any():
            break
        np.minimum.at(root, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
        while ((up := root[root]) != root).any():
            root = up
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _contracted(edges: DataFrame, count: int) -> DataFrame:
    """Of at most count edges, what tasks of up to EDGES edges make of them: a star for each component that a task sees."""
    schema, most = "a long, b long", EDGES
    want = shared.arrow_schema(edges.sparkSession, schema)

    def run(batches):
        parts, held = [], 0
        for x in batches:
            if held and held + x.num_rows > most:
                yield from put(parts)
                parts, held = [], 0
            parts.append((x.column("a").to_numpy(), x.column("b").to_numpy()))
            held += x.num_rows
        if held:
            yield from put(parts)

    def put(parts):
        high, low = stars(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        for i in range(0, len(high), 100_000):
            yield pa.RecordBatch.from_pydict({"a": low[i : i + 100_000], "b": high[i : i + 100_000]}, schema=want)

    plain = edges.select("a", "b").where("a <> b").coalesce(max(1, -(-count // most)))
    return shared.written(plain.mapInArrow(run, schema), "edges")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(uid, root) of every end of an edge of a written table; root is the smallest uid that it reaches.

    Tasks, in proportion to the edges, first make stars of the edges that they
    hold.  Then, in each round, a node goes to its first neighbour, and to that
    one's, by an order that is hashed anew, and the edges are drawn between what
    is left.  The order owes nothing to the uids, so a share of the nodes goes in
    each round whatever the shape, a chain in the order of its uids included.
    Where the edges that are left are one task's share, its stars are whole
    components and end it; rounds only guards against a fault.  Tables are
    written between.
    """
    found, count = None, edges.count()
    live = _contracted(edges, count)
    for turn in range(rounds):
        whole = count <= EDGES
        if whole:
            step = live.select(F.col("b").alias("u"), F.col("a").alias("p"))
        else:
            up = _mates(live, turn)
            step = shared.written(up.join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")), "roots")
        if found is None:
            found = step.select(F.col("u").alias("uid"), F.col("p").alias("root"))
            if whole:
                return found.unionByName(found.select(F.col("root").alias("uid"), "root").distinct())
        else:
            found = shared.written(found.join(step.select(F.col("u").alias("root"), F.col("p").alias("to")), "root", "left").select("uid", F.coalesce("to", "root").alias("root")), "roots")
        if whole:
            break
        count = live.count()
        drawn = live.join(step.select(F.col("u").alias("a"), F.col("p").alias("x")), "a").join(step.select(F.col("u").alias("b"), F.col("p").alias("y")), "b")
        live = _contracted(drawn.select(F.col("x").alias("a"), F.col("y").alias("b")), count)
    else:
        raise RuntimeError(f"edges are left after {rounds} rounds")
    least = found.groupBy("root").agg(F.min("uid").alias("least"))
    return shared.written(found.join(least, "root").select("uid", F.col("least").alias("root")), "roots")


def linked(sets: list[np.ndarray], percent: int, group: list[int]) -> list[tuple[int, int]]:
    """Links that join something among sets of which those of one group are joined already."""
    n, out = len(sets), []
    first: dict[int, int] = {}
    root = [first.setdefault(g, i) for i, g in enumerate(group)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))

    size = np.array([len(s) for s in sets], np.int64)
    if n <= SMALL:
        for i in range(n):
            for j in range(i + 1, n):
                if find(i) != find(j) and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        join(i, j)
        return out
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared_by = held[column] > 1  # others add to no intersection
    names, column = np.unique(column[shared_by], return_inverse=True)
    row = row[shared_by]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)  # counts below 2**24 are exact
    for lo in range(0, len(names), 1024):
        a, b = np.searchsorted(column, (lo, lo + 1024))
        m = np.zeros((n, min(1024, len(names) - lo)), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    for i in range(n):
        common = both[i].astype(np.int64)
        for j in np.flatnonzero(100 * common >= percent * (size[i] + size - common)).tolist():
            if j > i:
                join(i, j)
    return out


def link_parts(members: DataFrame, scanned: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of all pairs of different roots within families, from (family, parts, uid, root): a written table."""
    part = F.pmod(F.xxhash64("uid"), F.col("parts"))
    sent = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # a part on its own is compared where there is no other
    sent = sent.where("parts = 1 or part <> other").select("family", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "uid", "root")
    rows = scanned.select("uid", "packed").hint("merge").join(sent, "uid").select("family", "x", "y", "uid", "root", "packed")
    want = shared.arrow_schema(members.sparkSession, "a long, b long")

    def run(batches):
        now, held = None, []

        def put():
            sets = _unpacked_sets([p for _, _, p in held], k)
            got = linked(sets, percent, [r for _, r, _ in held])
            uid = [u for u, _, _ in held]
            return pa.RecordBatch.from_pydict({"a": [min(uid[i], uid[j]) for i, j in got], "b": [max(uid[i], uid[j]) for i, j in got]}, schema=want)

        for batch in batches:
            for f, x, y, *row in zip(*(batch.column(c).to_pylist() for c in ("family", "x", "y", "uid", "root", "packed")), strict=True):
                if (f, x, y) != now:
                    if len(held) > 1:
                        yield put()
                    now, held = (f, x, y), []
                held.append(row)
        if len(held) > 1:
            yield put()

    group = ["family", "x", "y"]
    return shared.written(rows.repartition(*group).sortWithinPartitions(*group, "uid").mapInArrow(run, "a long, b long"), "links")


def confirm(pairs: DataFrame, scanned: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity: a written table."""
    pairs = shared.written(pairs, "pairs")
    near = _mates(pairs, 0).select(F.col("u").alias("a"), F.col("p").alias("unit"))
    dealt = pairs.join(near, "a")
    many = dealt.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / UNIT_PAIRS).alias("parts"))
    dealt = shared.written(dealt.join(many, "unit").select("unit", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), "a", "b"), "dealt")
    needed = dealt.select("unit", "part", F.col("a").alias("uid")).unionByName(dealt.select("unit", "part", F.col("b").alias("uid"))).distinct()
    # a merge join whatever the size: what is broadcast here would grow with the pairs
    texts = needed.join(scanned.select("uid", "packed").hint("merge"), "uid").select("unit", "part", F.col("uid").alias("a"), F.lit(None).cast("long").alias("b"), "packed")
    rows = texts.unionByName(dealt.withColumn("packed", F.lit(None).cast("binary")))
    schema = "a long, b long"
    want = shared.arrow_schema(pairs.sparkSession, schema)

    def run(batches):
        import zstandard

        press, now, held, sets = zstandard.ZstdDecompressor(), None, [], {}

        def settle():
            if held:
                sets.update(zip([u for u, _ in held], shingle_sets([press.decompress(p) if p else b"" for _, p in held], k), strict=True))
                held.clear()

        for batch in batches:
            out = []
            for unit, part, a, b, packed in zip(*(batch.column(c).to_pylist() for c in ("unit", "part", "a", "b", "packed")), strict=True):
                if (unit, part) != now:
                    now, sets = (unit, part), {}
                    held.clear()
                if b is None:
                    held.append((a, packed))
                    continue
                settle()
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, schema=want)

    placed = rows.repartition("unit", "part").sortWithinPartitions("unit", "part", F.col("b").asc_nulls_first())
    return shared.written(placed.mapInArrow(run, schema), "links")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    from .words import mix

    return (mix(shingles) >> _U(44)).astype(np.int64) % BUCKETS


def _unpacked_sets(packed: list, k: int) -> list[np.ndarray]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return shingle_sets([press.decompress(p) if p else b"" for p in packed], k)


def _rarity(texts: DataFrame, k: int) -> np.ndarray:
    """How many sets have a shingle, by the bucket of its hash; shingles of one bucket add up."""
    schema = "bucket int, n long"
    want = shared.arrow_schema(texts.sparkSession, schema)

    def run(batches):
        count = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for s in _unpacked_sets(batch.column("packed").to_pylist(), k):
                np.add.at(count, _bucket(s), 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": count[at]}, schema=want)

    got = texts.select("packed").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def prefix_pairs(members: DataFrame, scanned: DataFrame, k: int, percent: int) -> DataFrame:
    """All pairs of different components, among the members (uid, root), that may have the similarity."""
    texts = shared.written(scanned.select("uid", "n", "signature", "packed").hint("merge").join(members, "uid"), "members")
    rarity = _rarity(texts, k)
    most = most_apart(percent)

    def head(batch):
        sets = _unpacked_sets(batch.column("packed").to_pylist(), k)
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u2").reshape(len(sets), -1)
        bits = bits_of(sig)
        firsts = []
        for s in sets:
            held = rarity[_bucket(s)]
            first = np.lexsort((s, held))[: len(s) - -(-percent * len(s) // 100) + 1]
            firsts.append(s[first[held[first] > 1]])  # no other set has the rest
        size = [len(f) for f in firsts]
        at = np.repeat(np.arange(len(sets)), size)
        yield {"shingle": np.concatenate(firsts).view(np.int64), **{c: batch.column(c).take(pa.array(at)) for c in ("uid", "n", "root")}, "bits": [bits[i].tobytes() for i in at.tolist()]}

    schema = "shingle long, uid long, n long, root long, bits binary"
    heads = shared.written(shared.arrow(texts, head, schema), "prefixes")
    mixed = heads.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("x <> y").select("shingle", "parts")
    dealt = heads.hint("merge").join(mixed, "shingle").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("shingle", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "uid", "n", "root", "bits")
    want = shared.arrow_schema(members.sparkSession, "a long, b long")

    def run(batches):
        group, now = [], None

        def put():
            uid, n, root = (np.array([g[i] for g in group], np.int64) for i in (1, 2, 3))
            part = np.array([g[0] for g in group], np.int64)
            bits = np.frombuffer(b"".join(g[4] for g in group), np.uint8).reshape(len(group), -1)
            a, b = [], []
            for i in range(len(group) - 1):
                ok = (root[i + 1 :] != root[i]) & (100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :]))
                if now[1] != now[2]:
                    ok &= part[i + 1 :] != part[i]
                j = np.flatnonzero(ok) + i + 1
                j = j[apart(bits[i], bits[j]) <= most]
                a.append(np.minimum(uid[i], uid[j]))
                b.append(np.maximum(uid[i], uid[j]))
            return pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)}, schema=want)

        for batch in batches:
            names = ("shingle", "x", "y", "part", "uid", "n", "root", "bits")
            for s, x, y, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (s, x, y) != now:
                    if len(group) > 1:
                        yield put()
                    group, now = [], (s, x, y)
                group.append(row)
        if len(group) > 1:
            yield put()

    block = ["shingle", "x", "y"]
    return dealt.repartition(*block).sortWithinPartitions(*block, "uid").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """uid (row number), doc_id, said (md5 of the text), n_shingles, component_id, kept of every row."""
    scanned = scan(docs, k, key, text)
    first = shared.written(scanned.where("node is not null").groupBy("node").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("doc_id")), "sets")
    nodes = shared.written(scanned.select("uid", "n", "signature").join(first.select(F.col("rep").alias("uid")), "uid", "left_semi"), "nodes")
    made = forest(nodes, percent)
    links = confirm(made.where("near").select("a", "b"), scanned, k, percent)
    found = components(links)
    family = components(made).withColumnRenamed("root", "family").join(found, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    family = shared.written(family.join(nodes.select("uid", "n"), "uid"), "families")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("parts")
    mixed = family.groupBy("family").agg(F.min("root").alias("x"), F.max("root").alias("y"), parts).where("x <> y").select("family", "parts")
    mixed = shared.written(family.join(mixed, "family").select("family", "parts", "uid", "root"), "mixed")
    more = link_parts(mixed.where(F.col("parts") <= PARTS), scanned, k, percent)
    large = mixed.where(F.col("parts") > PARTS).select("uid", "root")
    if not large.isEmpty():
        more = shared.written(more.unionByName(confirm(prefix_pairs(large, scanned, k, percent), scanned, k, percent)), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    rooted = first.join(found, first["rep"] == found["uid"], "left").select("node", "doc_id", F.coalesce("root", "rep").alias("root"))
    rooted = shared.written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = shared.written(rooted.join(least, "root").select("node", "component_id"), "components")
    rows = scanned.select("uid", "doc_id", "said", "node", F.col("n").alias("n_shingles"))
    linked = rows.where("node is not null").join(of_node, "node").select("uid", "doc_id", "said", "n_shingles", "component_id")
    alone = rows.where("node is null").select("uid", "doc_id", "said", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def report(docs: DataFrame, k: int = 3, percent: int = 85, **names) -> DataFrame:
    return near_duplicates(docs, k, percent, **names).drop("uid", "said")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns; of repeated rows one is.

    A row is told by its id and its text, so that the rows needn't be carried
    through the search; of rows with both equal the one whose JSON comes first stays.
    """
    kept = near_duplicates(docs, k, percent, key, text).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("said").alias("_said")).agg(F.count(F.lit(1)).alias("_n"))
    kept = shared.written(kept, "kept")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("id"), F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))).alias("said"))
    rows = held.join(kept, F.col("said").eqNullSafe(F.col("_said")) & F.col("id").eqNullSafe(F.col("_id"))).select("id", "said", "_n", "row")
    if not kept.where("_n > 1").isEmpty():
        first = rows.where("_n > 1").groupBy("id", "said").agg(F.min_by("row", F.to_json("row")).alias("row"))
        rows = rows.where("_n = 1").select("id", "said", "row").unionByName(first)
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
