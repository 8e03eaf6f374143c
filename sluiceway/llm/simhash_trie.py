"""SimHash near-duplicates: a self-join of binary tries under a Hamming budget.

A fingerprint has a bit for each bit position that is set in over half of the hashes of a text's shingles. Fingerprints are joined
by walking pairs of trie nodes together from the root: a pair's differing bits are summed up on the way down, and the
pair is dropped as soon as they exceed the budget. Small node pairs are compared row by row.

On a cluster the walk is cut as follows. With a budget of k bits and k+1 bands, two near fingerprints agree in at
least one whole band. So there are k+1 tries, each over the fingerprints rotated so that its band leads, and only the subtrees
below equal bands are walked against themselves. A subtree with over ``max_group`` fingerprints is cut into pairs of deeper
nodes (pairs beyond the budget never arise), again and again until every piece is small. That is the same walk with its upper levels done by
Spark's joins and its lower levels inside tasks, and it is exact for any size of group.

Copies are collapsed to distinct fingerprints first. Within a piece, links are reduced to one per fingerprint (to the smallest
fingerprint it is connected with), so that a dense group of near copies gives as many links as it has members, not their pairs.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and is linked like any other; shorter
texts than a shingle hash as a whole. Repeated rows and repeated keys are ordinary copies; a null key is kept and never
the smallest unless the component has no other. An empty table gives an empty result. Input columns named like an output
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import utf8, with_fields
from sluiceway.llm.components import components
from sluiceway.session import cut

MAX_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
MAX_GROUP = 50_000  # fingerprints of one trie node that a task takes; larger nodes are cut further
SPLIT_BITS = 4  # levels by which a large node is cut at once
LEAF = 2048  # node pairs of up to this many row pairs are compared directly
CHUNK = 1 << 18  # row pairs held at once


def fingerprint(data: bytes, size: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's bytes, A-Z read as a-z, as a signed 64-bit number."""
    words = data.lower().split()
    if not words:
        return 0
    digest, count, ones = xxhash.xxh64_digest, max(1, len(words) - size + 1), np.zeros(64, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[size - 1:] if len(words) >= size else ends[-1:]
    for at in range(0, count, 1 << 16):
        pieces = zip(starts[at:min(count, at + (1 << 16))].tolist(), last[at:at + (1 << 16)].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in pieces]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", into: str = "simhash", size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the fingerprint of each whole text (bigint). No shuffle."""
    def run(column: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([fingerprint(x, size) for x in column.to_pylist()], pa.int64())], names=[into])

    return with_fields(docs, F.arrow_udf(run, f"struct<{into}: bigint>")(utf8(text)), (into,))


# --- the walk inside a task -------------------------------------------------------------------------------------------


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; label[x] is the smallest known member of x's set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First row of each node [lo, hi) whose ``bit`` is set; rows of a node are sorted and agree above that bit."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (keys[np.minimum(mid, len(keys) - 1)] >> bit & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def walk(keys: np.ndarray, roots: np.ndarray, budget: int, leaf: int = LEAF) -> np.ndarray:
    """Smallest connected row for every row. ``keys``: uint64, sorted within each node. ``roots``: node pairs as rows of
    (a_lo, a_hi, b_lo, b_hi, depth, differing bits so far); a node against itself has equal ranges."""
    label = np.arange(len(keys))
    stack = [roots.astype(np.int64)]
    while stack:
        pairs = stack.pop()
        if len(pairs) > 50_000:
            stack.append(pairs[50_000:])
            pairs = pairs[:50_000]
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        direct = (na * nb <= leaf) | (pairs[:, 4] >= 64)
        small, pairs = pairs[direct], pairs[~direct]
        label = _compare(keys, small, budget, label)
        if not len(pairs):
            continue
        bit = (63 - pairs[:, 4]).astype(np.uint64)
        same = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3])
        a_mid, b_mid = _split(keys, pairs[:, 0], pairs[:, 1], bit), _split(keys, pairs[:, 2], pairs[:, 3], bit)
        a_lo, a_hi, b_lo, b_hi, depth, bits = pairs.T
        children = [
            np.stack([a_lo, a_mid, b_lo, b_mid, depth + 1, bits], 1),
            np.stack([a_mid, a_hi, b_mid, b_hi, depth + 1, bits], 1),
            np.stack([a_lo, a_mid, b_mid, b_hi, depth + 1, bits + 1], 1),
            np.stack([a_mid, a_hi, b_lo, b_mid, depth + 1, bits + 1], 1)[~same],
        ]
        for part in children:
            part = part[(part[:, 1] > part[:, 0]) & (part[:, 3] > part[:, 2]) & (part[:, 5] <= budget)]
            if len(part):
                stack.append(part)
    return label


def _compare(keys: np.ndarray, pairs: np.ndarray, budget: int, label: np.ndarray) -> np.ndarray:
    """Compare all rows of small node pairs, a bounded number at a time."""
    sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    ends = np.cumsum(sizes)
    start = 0
    while start < len(pairs):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        part, size = pairs[start:stop], sizes[start:stop]
        for lo in range(0, int(size.sum()) if len(part) == 1 else 1, CHUNK):  # one node pair of equal keys may be larger
            if len(part) == 1:
                inside = np.arange(lo, min(lo + CHUNK, int(size[0])))
                owner = np.zeros(len(inside), np.int64)
            else:
                owner = np.repeat(np.arange(len(part)), size)
                inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            width = (part[:, 3] - part[:, 2])[owner]
            a, b = part[owner, 0] + inside // width, part[owner, 2] + inside % width
            near = (a < b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
            label = _merge(label, a[near], b[near])
        start = stop
    return label


def _walk_groups(budget: int, leaf: int):
    """Tasks get rows (g: piece, depth, bits, cut: rows of the first node or -1, key: rotated fingerprint, fp), pieces together."""

    def solve(g, depth, bits, side, key, fp):
        order = np.lexsort((key, side, g))
        g, depth, bits, side, key, fp = (x[order] for x in (g, depth, bits, side, key, fp))
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        last = np.r_[first[1:], len(g)]
        two = bits[first] >= 0
        cut_at = first + np.add.reduceat((side == 0).astype(np.int64), first)
        roots = np.stack([first, np.where(two, cut_at, last), np.where(two, cut_at, first), last, depth[first], np.maximum(bits[first], 0)], 1)
        roots = roots[(roots[:, 1] > roots[:, 0]) & (roots[:, 3] > roots[:, 2])]
        label = walk(key, roots, budget, leaf)
        linked = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            cols[4] = cols[4].view(np.uint64)
            held.append(tuple(cols))
            rows += batch.num_rows
            if rows > 200_000:  # all pieces but the last are complete
                g = np.concatenate([h[0] for h in held])
                end = int(np.flatnonzero(g != g[-1]).max(initial=-1)) + 1
                if end:
                    whole = [np.concatenate([h[k] for h in held]) for k in range(6)]
                    yield solve(*(x[:end] for x in whole))
                    held, rows = [tuple(x[end:] for x in whole)], len(g) - end
        if held:
            yield solve(*(np.concatenate([h[k] for h in held]) for k in range(6)))

    return run


# --- the walk's upper levels in Spark ---------------------------------------------------------------------------------


def _bands(budget: int) -> list[tuple[int, int]]:
    """(offset, width) of budget+1 bands over 64 bits."""
    count = budget + 1
    edges = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _node(key: Column, depth: Column, width: int) -> Column:
    """The ``width`` bits below ``depth`` levels."""
    return F.call_function("shiftrightunsigned", F.call_function("shiftleft", key, depth), F.lit(64 - width))


def links(distinct: DataFrame, budget: int = MAX_BITS, max_group: int = MAX_GROUP, leaf: int = LEAF) -> DataFrame:
    """(a, b) of linked fingerprints among the distinct ones of column ``fp``: enough links to connect all that differ in at most
    ``budget`` bits, and no others."""
    pieces = []
    for band, (offset, width) in enumerate(_bands(budget)):
        key = _rotated(F.col("fp"), offset)
        pieces.append(F.struct(
            F.xxhash64(F.lit(band), F.shiftrightunsigned(key, 64 - width)).alias("g"), F.lit(width).alias("depth"),
            F.lit(-1).alias("bits"), F.lit(0).alias("side"), key.alias("key"),
            F.concat_ws(":", F.lit(band), F.shiftrightunsigned(key, 64 - width)).alias("path"),
        ))
    todo = distinct.select("fp", F.explode(F.array(*pieces)).alias("p")).select("fp", "p.*")
    done = []
    over = (F.col("n") > max_group) & (F.col("d") <= 64 - SPLIT_BITS)
    while True:
        # A pair of nodes of which one has no rows is no piece.
        whole = (F.max("bits") < 0) | (F.min("side") != F.max("side"))
        sizes = todo.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d"), whole.alias("whole"))
        large = cut(sizes.where(over & F.col("whole")).select("path"))
        if done:
            done.append(todo.join(sizes.where(~over & F.col("whole")).select("path"), "path", "left_semi"))
        else:
            done.append(todo.join(large, "path", "left_anti"))
        if large.isEmpty():
            break
        todo = cut(_cut_pieces(todo.join(large, "path", "left_semi"), budget))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    rows = out.select(F.xxhash64("path").alias("g"), "depth", "bits", "side", "key", "fp")
    dealt = rows.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(_walk_groups(budget, leaf), "a bigint, b bigint")


def _cut_pieces(rows: DataFrame, budget: int) -> DataFrame:
    """Each piece as pairs of nodes ``SPLIT_BITS`` deeper: node x of the first side with node y of the second, their differing bits
    added. A row goes to every pair its node is part of."""
    own = _node(F.col("key"), F.col("depth"), SPLIT_BITS).cast("int")
    nodes = F.sequence(F.lit(0), F.lit(2**SPLIT_BITS - 1))
    alone = F.col("bits") < 0
    before = F.greatest(F.col("bits"), F.lit(0))

    def pair(other: Column) -> Column:
        differ = F.bit_count(own.bitwiseXOR(other)).cast("int")
        # A node against itself keeps one side; otherwise the row's side follows its node, or the side it had.
        low, high = F.least(own, other), F.greatest(own, other)
        itself = alone & (own == other)
        mine = F.col("side") == 0
        return F.struct(
            F.when(itself, F.lit(-1)).otherwise(before + differ).alias("bits"),
            F.when(alone, F.when(own <= other, F.lit(0)).otherwise(F.lit(1))).otherwise(F.col("side")).alias("side"),
            F.when(alone, F.concat_ws(".", "path", low, high))
            .otherwise(F.concat_ws(".", "path", F.when(mine, own).otherwise(other), F.when(mine, other).otherwise(own))).alias("path"),
        )

    cut_rows = rows.select("fp", "g", "depth", "key", F.explode(F.filter(F.transform(nodes, pair), lambda p: p.bits <= budget)).alias("p"))
    return cut_rows.select("fp", "g", (F.col("depth") + SPLIT_BITS).alias("depth"), "p.bits", "p.side", "key", "p.path")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = MAX_BITS, size: int = SHINGLE_WORDS,
           max_group: int = MAX_GROUP) -> DataFrame:
    """(key, simhash, component_id) for every row of ``docs``; component_id is the smallest key reachable over links."""
    marked = cut(fingerprints(docs, text, "simhash", size).select(F.col(key), F.col("simhash").alias("fp")))
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("least")))
    rooted = components(links(distinct, budget, max_group))
    named = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col(key), F.col("fp").alias("simhash"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = MAX_BITS, size: int = SHINGLE_WORDS,
             max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest key; of rows that repeat it, one. Rows without a key
    cannot be named and stay."""
    keyed = docs.where(F.col(key).isNotNull())
    grouped = groups(keyed, key, text, budget, size, max_group)
    stays = grouped.where(F.col(key) == F.col("component_id")).select(key).distinct()
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull()))
