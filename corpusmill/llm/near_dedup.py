"""Near duplicates by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one node; sets are told apart by 128 bits.
Each of TREES trees orders the nodes by DEPTH MinHash values; a tree is stored as
a sorted table, in which the rows that share a prefix stand together. A node's
candidates in a tree are those of its neighbours there with the longest common
prefixes: its depth is the longest prefix that REACH of them share with it, and
MIN_DEPTH at least, so it is deep where many nodes resemble each other and low
where few do. At a similarity of 0.75 two nodes share MIN_DEPTH values in some
tree but for a chance of 5e-6.

Links are confirmed on full sets: first along one order, which sends each set
once and settles most of every dense region; then for each candidate pair whose
ends that left in different components.

Nodes of a crowded region, where neighbours are not all there is, are compared
without such a bound too: two similar sets share one of their rarest shingles, so
nodes of different components that share one are confirmed as well. Rarity is
read from a sketch of counts of fixed size; it only orders the shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.bitmap import among, bitmap
from corpusmill.llm.graph import components
from corpusmill.llm.kernels import arrow_map, byte_values, mix, released, space_table, text_bytes, window_hashes, word_hashes, words
from corpusmill.shared import give_back, heavy_join, scratch, small_batches, written

U = np.uint64
SHINGLE = 5
TREES, MIN_DEPTH, DEPTH = 32, 4, 8
#: Neighbours in a sorted order that a node is compared with, before it.
REACH = 4
#: Rows at a partition's border, and rows whose span makes a region crowded.
EDGE = REACH + 1
#: Sets that a set is compared with along an order, and the shingles they may have together.
HELD, HELD_ITEMS = 32, 1 << 20
#: Counters of the sketch of shingle counts (4 MB).
COUNTERS = 1 << 20
#: A link has PERCENT * |union| <= 100 * |intersection|.
PERCENT = 75


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's runs of SHINGLE words; of all its words, if it has fewer."""
    data, at = text_bytes(column)
    begin, end, rows = words(data, at, space_table())
    own = word_hashes(data, begin, end, byte_values(True))
    grams = window_hashes(own, SHINGLE)
    out = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(window_hashes(own[a:b], int(b - a)) ^ U(b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(424242)
    n = TREES * MIN_DEPTH
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, TREES * MIN_DEPTH) MinHash values of 16 bits; the values of empty sets mean nothing."""
    full = [s for s in sets if len(s)]
    out = np.zeros((len(sets), TREES * MIN_DEPTH), np.uint16)
    if full:
        every = mix(np.concatenate(full))
        starts = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
        least = np.empty((len(full), TREES * MIN_DEPTH), np.uint16)
        for k, (a, b) in enumerate(zip(*_multipliers(), strict=True)):
            low = np.minimum.reduceat((every * a + b) >> U(20), starts)
            least[:, k] = mix(low) & U(0xFFFF)
        out[[i for i, s in enumerate(sets) if len(s)]] = least
    return out


def node_of(values: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two hashes of a set, the first of ``bits`` bits."""
    first, second = (np.add.reduce(mix(values ^ U(x))) for x in (0xA5A5A5A5A5A5A5A5, 0xC2B2AE3D27D4EB4F))
    return tuple(np.array([first & U((1 << bits) - 1), second], U).astype(np.int64).tolist())


def sketches(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, row_key, n_shingles, node, check and signature of each document; node and check are null for the empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("signature", pa.binary())])

    def work(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column(1))
        node, check = zip(*[node_of(s, bits) if len(s) else (None, None) for s in sets], strict=True)
        return {"doc_id": batch.column(0), "row_key": batch.column(2), "n_shingles": [len(s) for s in sets], "node": node, "check": check, "signature": [r.tobytes() for r in signatures(sets)]}

    return docs.withColumn("row_key", F.xxhash64("doc_id", "text")).mapInArrow(arrow_map(work, schema), "doc_id long, row_key long, n_shingles long, node long, check long, signature binary")


def told_apart(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """``rows`` with node renamed by check where ``shared`` lists it: where sets that differ have the same node."""
    if shared is None:
        return rows
    named = rows.join(shared.withColumn("_shared", F.lit(True)), "node", "left")
    return named.withColumn("node", F.when(F.col("_shared"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("_shared")


def tree_keys(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and tree: its first MIN_DEPTH values with the tree, hashed, and the further values in order.

    The further values are those of other trees: a tree costs MIN_DEPTH values.
    """
    own = signature.reshape(len(signature), TREES, MIN_DEPTH).astype(U)
    packed = own[:, :, 0]
    for k in range(1, MIN_DEPTH):
        packed = packed << U(16) | own[:, :, k]
    head = mix(packed ^ (np.arange(1, TREES + 1, dtype=U) * U(0x9E3779B97F4A7C15)))
    return head, np.roll(packed, -7, axis=1)


def _forest(nodes: DataFrame) -> DataFrame:
    schema = pa.schema([("head", pa.int64()), ("rest", pa.int64()), ("node", pa.int64())])

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, -1)
                head, rest = tree_keys(sig)
                node = np.repeat(part.column(0).to_numpy(), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (head.ravel().astype(np.int64), rest.ravel().astype(np.int64), node)], schema=schema)

    return nodes.select("node", "signature").mapInArrow(released(work), "head long, rest long, node long")


def common_prefixes(head: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """How many values each row shares with the one after it, from the first; 0 where that is below MIN_DEPTH."""
    differ = (rest[1:] ^ rest[:-1]).astype(U)
    further = sum((differ >> U(16 * k) == 0).astype(np.int64) for k in range(DEPTH - MIN_DEPTH))
    return np.where(head[1:] == head[:-1], MIN_DEPTH + further, 0)


def candidates(shared: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each distance d up to REACH, the rows i of which i and i + d are candidates.

    ``shared`` are the common prefixes of neighbouring rows. Of the rows within
    REACH of a row, those with its REACH longest common prefixes are taken, and
    all that share as much.
    """
    n = len(shared) + 1
    far = np.zeros((REACH + 1, n), np.int64)  # far[d, i]: the prefix that rows i to i + d share
    if n > 1:
        far[1, :-1] = shared
    for d in range(2, REACH + 1):
        if n > d:
            far[d, : n - d] = np.minimum(far[d - 1, : n - d], shared[d - 1 :])
    sides = [far[d] for d in range(1, REACH + 1)]
    for d in range(1, REACH + 1):
        behind = np.zeros(n, np.int64)
        behind[d:] = far[d, : max(0, n - d)]
        sides.append(behind)
    depth = np.maximum(MIN_DEPTH, np.partition(np.stack(sides), REACH, axis=0)[REACH])
    out = []
    for d in range(1, REACH + 1):
        own = far[d, : max(0, n - d)]
        out.append((d, np.flatnonzero((own >= depth[: len(own)]) | (own >= depth[d:]))))
    return out


def neighbours(sorted_rows: DataFrame) -> DataFrame:
    """Pairs of candidates in each sorted partition, crowded nodes, and the rows at its borders.

    A pair has border null, a crowded node b too. A border row has its node in a
    and its place in border: 0.. from the front, -1.. from the back, its head in b.
    Rows are held until all that may decide on them is there.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("border", pa.int32())])

    def work(batches):
        part = TaskContext.get().partitionId()
        head, rest, node = (np.zeros(0, np.int64) for _ in range(3))
        done = front = 0  # rows held that have met those after them, and border rows sent
        first = None

        def rows(a, b, border=None):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array([part if border is not None else None] * n, pa.int32()), pa.array(border if border is not None else [None] * n, pa.int32())], schema=schema)

        def met(ready):
            """Pairs of the rows from ``done`` to ``ready`` with later ones, and crowded nodes."""
            shared = common_prefixes(head, rest)
            found = [np.stack([node[i], node[i + d]]) for d, i in ((d, i[(i >= done) & (i < ready)]) for d, i in candidates(shared))]
            both = np.concatenate(found, axis=1)
            both = both[:, both[0] != both[1]]
            if both.shape[1]:
                yield rows(both.min(0), both.max(0))
            same = np.flatnonzero(head[EDGE:] == head[:-EDGE])
            same = same[(same >= done) & (same < ready)]
            if len(same):
                yield rows(node[np.unique(same[:, None] + np.arange(EDGE + 1))], None)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy() for k in range(3)]
            if front < EDGE:
                n = min(EDGE - front, len(new[0]))
                yield rows(new[2][:n], new[0][:n], list(range(front, front + n)))
                front += n
            # The first row of a run meets all of it, wherever they are.
            run = np.maximum.accumulate(np.where(np.concatenate([[True], new[0][1:] != new[0][:-1]]), np.arange(len(new[0])), 0))
            lead = new[2][run]
            if first is not None:
                lead = np.where(new[0] == first[0], first[1], lead)
            first = int(new[0][-1]), int(lead[-1])
            star = np.stack([lead, new[2]])[:, lead != new[2]]
            if star.shape[1]:
                yield rows(star.min(0), star.max(0))
            head, rest, node = (np.concatenate(x) for x in zip((head, rest, node), new, strict=True))
            ready = max(done, len(head) - 2 * EDGE)
            yield from met(ready)
            cut = max(0, ready - 2 * EDGE)
            head, rest, node, done = head[cut:], rest[cut:], node[cut:], ready - cut
        if len(head):
            yield from met(len(head))
            yield rows(node[-EDGE:], head[-EDGE:], [-k for k in range(min(EDGE, len(head)), 0, -1)])

    return sorted_rows.mapInArrow(released(work), "a long, b long, part int, border int")


def border_pairs(rows: list[tuple[int, int, int, int]]) -> tuple[set[tuple[int, int]], set[int]]:
    """Pairs across partitions and crowded nodes at their borders, of rows (part, border, head, node)."""
    out, crowded, last, lead = set(), set(), [], {}
    for part in sorted({r[0] for r in rows}):
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == part)
        front, back = [r[1:] for r in own if r[0] >= 0], [r[1:] for r in own if r[0] < 0]
        for head, node in front:
            out |= {(min(node, o), max(node, o)) for h, o in last if h == head and o != node}
        for head, node in front[:1]:
            if head in lead and lead[head] != node:
                out.add((min(node, lead[head]), max(node, lead[head])))
            across = {o for h, o in last + front if h == head}
            if any(h == head for h, _ in last) and len(across) >= REACH:
                crowded |= across
        lead = {front[0][0]: lead.get(front[0][0], front[0][1])} if front and back[-1][0] == front[0][0] else {h: n for h, n in back[-1:]}
        last = (last + back)[-EDGE:]
    return out, crowded


def _sketch(sets: DataFrame) -> bytes:
    """How often shingles occur, by hash: COUNTERS counts of 32 bits, summed over partitions block by block."""
    size = 1 << 14

    def count(batches):
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for items in batch.column(0).to_pylist():
                np.add.at(total, np.frombuffer(items, U) & U(COUNTERS - 1), 1)
        at = [k for k in range(COUNTERS // size) if total[k * size : (k + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[k * size : (k + 1) * size].tobytes() for k in at], pa.binary())], names=["k", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(c, np.uint32) for c in table["counts"].to_pylist()], axis=0, dtype=np.uint32)
        return pa.table({"k": [table["k"][0].as_py()], "counts": [total.tobytes()]})

    whole = bytearray(COUNTERS * 4)
    for r in sets.select("items").mapInArrow(released(count), "k long, counts binary").groupBy("k").applyInArrow(add, "k long, counts binary").collect():
        whole[r["k"] * size * 4 : (r["k"] + 1) * size * 4] = r["counts"]
    return bytes(whole)


def _across(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may link, of sets (node, component, items): all that do are among them."""
    shipped = sets.sparkSession.sparkContext.broadcast(_sketch(sets))
    names = ["item", "at", "node", "component", "n"]

    def rarest(batches):
        counts = np.frombuffer(shipped.value, np.uint32)
        for batch in batches:
            got = []
            for node, component, items in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = np.frombuffer(items, U)
                n = len(own)
                first = own[np.lexsort((own, counts[own & U(COUNTERS - 1)]))[: n - -(-PERCENT * n // 100) + 1]]
                got.append((first.astype(np.int64), np.arange(len(first)), np.full(len(first), node), np.full(len(first), component), np.full(len(first), n)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*got, strict=True)], names=names)

    rows = written(sets.select("node", "component", "items").mapInArrow(released(rarest), "item long, at long, node long, component long, n long"), "rarest")
    shared = rows.groupBy("item").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("item")
    met = written(rows.join(shared, "item", "left_semi"), "met")
    x, y = (met.select("item", *[F.col(c).alias(f"{side}_{c}") for c in names[1:]]) for side in "xy")
    # What two linked sets share at least, and where the first shared shingle must stand then.
    least = F.floor((PERCENT * (F.col("x_n") + F.col("y_n")) + 99 + PERCENT) / (100 + PERCENT))
    near = (F.col("x_component") < F.col("y_component")) & (F.col("x_at") <= F.col("x_n") - least) & (F.col("y_at") <= F.col("y_n") - least)
    return x.join(y, "item").where(near).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sets(docs: DataFrame, wanted: DataFrame, bits: int, shared: DataFrame | None) -> DataFrame:
    """node, set and its places in two orders for the wanted nodes, and by chance for some others."""
    first_hash = wanted if shared is None else wanted.unionByName(shared)
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(first_hash, "node", first_hash.count()))
    schema = pa.schema([("node", pa.int64()), ("check", pa.int64()), ("place", pa.int64()), ("place2", pa.int64()), ("items", pa.binary())])

    def work(batch: pa.RecordBatch) -> dict | None:
        a, b = _multipliers()
        sets = [s for s in shingle_sets(batch.column(1)) if len(s)]
        own = np.array([node_of(s, bits) for s in sets], np.int64).reshape(-1, 2)
        got = []
        for k in np.flatnonzero(among(own[:, 0], shipped.value)):
            low = (mix(sets[k])[None, :] * a[:4, None] + b[:4, None] >> U(20)).min(1)
            places = [int(x << U(20) | y >> U(24)) - (1 << 63) for x, y in (low[:2], low[2:])]
            got.append((*own[k].tolist(), *places, sets[k].tobytes()))
        return dict(zip(schema.names, zip(*got, strict=True), strict=True)) if got else None

    made = docs.mapInArrow(arrow_map(work, schema), "node long, check long, place long, place2 long, items binary")
    return told_apart(made, shared).groupBy("node").agg(F.first("place").alias("place"), F.first("place2").alias("place2"), F.first("items").alias("items"))


def _along(sets: DataFrame, order: str) -> DataFrame:
    """Confirmed links (u, v) of sets that stand near each other in an order.

    A set meets the HELD sets before it, but none that is known to be in its
    component: in a dense region most are, so few are compared.
    """

    def work(batches):
        held: list[tuple[int, np.ndarray]] = []
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.get(x, x) != x:
                x = above[x]
            return x

        for batch in batches:
            found = []
            for node, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(items, U)
                above[node] = node
                for other, theirs in reversed(held):
                    a, b = top(node), top(other)
                    if a != b and linked(own, theirs):
                        above[max(a, b)] = min(a, b)
                        found.append((max(node, other), min(node, other)))
                held.append((node, own))
                while len(held) > HELD or len(held) > 1 and sum(len(x) for _, x in held) > HELD_ITEMS:
                    held.pop(0)
            above = {n: top(n) for n, _ in held} | {top(n): top(n) for n, _ in held}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.select("node", "items", order).repartitionByRange(n, order, "node").sortWithinPartitions(order, "node").mapInArrow(released(work), "u long, v long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) that link, as (u, v)."""

    def work(batches):
        for batch in batches:
            keep = [linked(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            if any(keep):
                yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(keep)), batch.column(0).filter(pa.array(keep))], names=["u", "v"])

    own = sets.select("node", "items")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(released(work), "u long, v long")


def _stars(placed: DataFrame) -> DataFrame:
    return placed.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))


def near_duplicates(docs: DataFrame, node_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, row_key.

    A text without words, null included, has an empty set and is linked with
    nothing. Rows that repeat get repeated rows; a null doc_id is linked with
    nothing, has a null component_id and is kept. A long text is one row: the
    memory of a task grows with the longest text. Other columns take no part,
    whatever their names. node_bits is the width of a node's first hash; sets
    that share it are told apart by a second one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with scratch() as keep:
        drawn = written(sketches(docs, node_bits), "sketches")
        shared = drawn.where("node IS NOT NULL").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node")
        shared = None if shared.isEmpty() else written(shared, "shared")
        keep(drawn, shared)
        drawn = told_apart(drawn, shared)
        nodes = written(drawn.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("signature").alias("signature")), "nodes")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        trees = _forest(nodes).repartitionByRange(n, "head", "rest", "node").sortWithinPartitions("head", "rest", "node")
        met = written(neighbours(trees), "neighbours")
        # 2 * EDGE rows for each partition, however many nodes there are.
        border = [(r["part"], r["border"], r["b"], r["a"]) for r in met.where("border IS NOT NULL").collect()]
        across, edge = border_pairs(border)
        pair_rows = spark.createDataFrame(pa.table({"a": pa.array([x for x, _ in sorted(across)], pa.int64()), "b": pa.array([x for _, x in sorted(across)], pa.int64())}))
        edge_rows = spark.createDataFrame(pa.table({"node": pa.array(sorted(edge), pa.int64())}))
        pairs = written(met.where("border IS NULL AND b IS NOT NULL").select("a", "b").unionByName(pair_rows).distinct(), "pairs")
        crowded = written(met.where("border IS NULL AND b IS NULL").select(F.col("a").alias("node")).unionByName(edge_rows).distinct(), "crowded")
        give_back(spark)
        sets = written(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), node_bits, shared), "sets")
        first = components(_along(sets, "place").unionByName(_along(sets, "place2")))
        give_back(spark)
        left = pairs.join(first.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(first.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        apart = left.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
        if not crowded.isEmpty():
            own = sets.join(crowded, "node", "left_semi").join(first, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "items")
            apart = apart.unionByName(_across(written(own, "crowded_sets"))).distinct()
        last = components(_stars(first).unionByName(_confirmed(apart, sets)))
        give_back(spark)
        placed = nodes.select("node", "least", "size").join(last, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("many"))
        classes = written(heavy_join(placed, least, ["component"], "many").select("node", "size", "component_id"), "classes")
        keep(classes)
    known = heavy_join(drawn.where("node IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "row_key", "n_shingles", "node"), classes, ["node"], "size")
    alone = drawn.where("node IS NULL OR doc_id IS NULL").select("doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id"))
    every = known.select("doc_id", "row_key", "n_shingles", "component_id").unionByName(alone)
    return every.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row_key")
