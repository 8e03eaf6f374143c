"""Line dedup by pairwise alignment.

A line is a stretch of text between line breaks; its identity is the digest of the line without white space around it, and lines
without a word are left out of everything. Of two documents the later one has the larger key (null keys last; documents that share a
key are ordered by a hash of the text). The owner of a line is the earliest document that has it.

Overlapping documents are found through the lines they share: a document is paired with the owner of each of its lines. Rare lines find most partners; for a
common line the owner is the partner as well, so there is at most one pair for each line of a document, however many have the line, and what is deleted does
not depend on how common a line is. Both documents of a pair are aligned by patience diff over their shared lines, and each aligned common block of at least
``min_words`` words is deleted from the later one. A block is a run of aligned lines that are neighbours in both documents; it lies in that one earlier document. The
lines found are taken out of the later side and the rest is aligned again with the whole earlier side, until nothing more is found, so moved and repeated blocks go
too. Where lines remain that the alignment cannot place (all of them repeated in their gap), runs of them are looked up in the earlier document.

No line is lost: the owner of a line has no earlier document to be aligned with on it.

Only digests and positions are shuffled; texts move once, to meet their edits. Lists are as long as one document's shared lines. Very common
lines are plain skewed keys of a join.

Defined cases: a null text stays null and has no lines; an empty text stays empty. Rows equal in key and text are one document and are edited alike. An
empty table gives an empty result. Input columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import without
from sluiceway.session import cut

SPACE = b" \t\n\r\x0b\x0c"
MIN_WORDS = 5
OUTPUTS = ("n_lines", "n_words", "deleted_lines", "deleted_words", "n_partners")


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting: each value goes on the leftmost pile whose top
    is not smaller and remembers the top of the pile to its left."""
    tops: list[int] = []
    piles: list[int] = []
    left: list[int] = []
    for place, value in enumerate(values):
        lo, hi = 0, len(tops)
        while lo < hi:
            mid = (lo + hi) // 2
            if tops[mid] < value:
                lo = mid + 1
            else:
                hi = mid
        left.append(piles[lo - 1] if lo else -1)
        if lo == len(tops):
            tops.append(value)
            piles.append(place)
        else:
            tops[lo], piles[lo] = value, place
    out, place = [], piles[-1] if piles else -1
    while place >= 0:
        out.append(place)
        place = left[place]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: matched places of two sequences, increasing in both.

    Equal ends are matched; between them the elements that occur once on each side are matched along a longest increasing
    run, and the gaps between these are treated likewise. A gap without such elements and equal ends stays unmatched.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where: dict = {}
        for i in range(a0, a1):
            where[a[i]] = -1 if a[i] in where else i
        once: dict = {}
        for j in range(b0, b1):
            if where.get(b[j], -1) >= 0:
                once[b[j]] = -1 if b[j] in once else j
        anchors = [(where[x], j) for x, j in once.items() if j >= 0]
        anchors.sort(key=lambda p: p[1])
        chain = [anchors[k] for k in increasing([i for i, _ in anchors])]
        if not chain:
            continue
        out += chain
        for (i, j), (m, n) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]):
            if i + 1 < m and j + 1 < n:
                todo.append((i + 1, m, j + 1, n))
    return sorted(out)


def longest_runs(a: list, b: list) -> list[int]:
    """For each place of ``b`` the length of the longest run that ends there and lies anywhere in ``a``.

    A suffix automaton of ``a`` reads ``b``, so time and memory are linear however often elements repeat. None is equal to nothing.
    """
    steps, links, lengths, last = [{}], [-1], [0], 0
    for x in (object() if x is None else x for x in a):
        new, at = len(steps), last
        steps.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        while at >= 0 and x not in steps[at]:
            steps[at][x] = new
            at = links[at]
        if at >= 0:
            to = steps[at][x]
            if lengths[to] != lengths[at] + 1:
                copy = len(steps)
                steps.append(dict(steps[to]))
                links.append(links[to])
                lengths.append(lengths[at] + 1)
                links[to] = copy
                while at >= 0 and steps[at].get(x) == to:
                    steps[at][x] = copy
                    at = links[at]
                to = copy
            links[new] = to
        last = new
    out, at, n = [], 0, 0
    for x in b:
        while at and x not in steps[at]:
            at = links[at]
            n = lengths[at]
        if x in steps[at]:
            at, n = steps[at][x], n + 1
        out.append(n)
    return out


def _with_gaps(entries: list[dict]) -> list[dict | None]:
    """The entries, with None where lines that are not shared lie between two of them."""
    out: list[dict | None] = []
    for k, x in enumerate(entries):
        if k and x["pos"] != entries[k - 1]["pos"] + 1:
            out.append(None)
        out.append(x)
    return out


def anywhere(earlier: list[dict], later: list[dict], min_words: int) -> list[int]:
    """Line numbers of ``later`` in runs of enough words that lie anywhere in ``earlier``, in any order and any number of times."""
    a, b = _with_gaps(earlier), _with_gaps(later)
    runs = longest_runs([x and (x["h"], x["g"]) for x in a], [x and (x["h"], x["g"]) for x in b])
    before = [0, *accumulate(x["words"] if x else 0 for x in b)]
    out, start = [], len(b)
    for end in range(len(b) - 1, -1, -1):
        first = end + 1 - runs[end]
        if runs[end] and before[end + 1] - before[first] >= min_words:
            start = min(start, first)
        if start <= end:
            out.append(b[end]["line"])
    return out[::-1]


def common_blocks(earlier: list[dict], later: list[dict], min_words: int) -> list[int]:
    """Line numbers of ``later`` in blocks of enough words that ``earlier`` has, by alignments of what is left until no block is found. Entries: line (number),
    pos (number among lines with words), h and g (digest), words."""
    gone: set[int] = set()
    rest = later
    while rest and (found := aligned_blocks(earlier, rest, min_words)):
        gone.update(found)
        rest = [x for x in rest if x["line"] not in gone]
    there = {(x["h"], x["g"]) for x in earlier}
    if any((x["h"], x["g"]) in there for x in rest):
        gone.update(anywhere(earlier, later, min_words))
    return sorted(gone)


def aligned_blocks(earlier: list[dict], later: list[dict], min_words: int) -> list[int]:
    """Line numbers of ``later`` in aligned blocks of enough words."""
    out: list[int] = []
    block: list[dict] = []
    last = None
    for i, j in [*align([(x["h"], x["g"]) for x in earlier], [(x["h"], x["g"]) for x in later]), (None, None)]:
        here = None if i is None else (earlier[i]["pos"], later[j]["pos"])
        if block and (here is None or here != (last[0] + 1, last[1] + 1)):
            if sum(x["words"] for x in block) >= min_words:
                out += [x["line"] for x in block]
            block = []
        if here is not None:
            block.append(later[j])
            last = here
    return out


def _aligned(min_words: int):
    def run(earlier: pa.Array, later: pa.Array) -> pa.Array:
        pairs = zip(earlier.to_pylist(), later.to_pylist())
        return pa.array([common_blocks(a, b, min_words) for a, b in pairs], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text))


def _lines(column: pa.Array) -> pa.Array:
    """The lines with words of each text."""
    sizes, line, pos, digests, words = [], [], [], [], []
    for scalar in column:
        if not scalar.is_valid:
            sizes.append(0)
            continue
        n = 0
        for k, raw in enumerate(scalar.as_buffer().to_pybytes().split(b"\n")):
            count = len(raw.split())
            if count:
                line.append(k)
                pos.append(n)
                digests.append(hashlib.blake2b(raw.strip(SPACE), digest_size=16).digest())
                words.append(count)
                n += 1
        sizes.append(n)
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    fields = [pa.array(line, pa.int32()), pa.array(pos, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(words, pa.int32())]
    offsets = pa.array(np.r_[0, np.cumsum(np.array(sizes, np.int64))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["line", "pos", "h", "g", "words"]))


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc: struct of key and text hash, gone: line numbers to delete, n_partners) for documents that lose lines."""
    doc = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), _text_hash(text).alias("hash"))
    find = F.arrow_udf(_lines, "array<struct<line: int, pos: int, h: bigint, g: bigint, words: int>>")
    lines = docs.where(F.col(text).isNotNull()).select(doc.alias("doc"), F.explode(find(F.col(text).cast("binary"))).alias("x")).select("doc", "x.*")
    owners = lines.groupBy("h", "g").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
    # Written out, so that both sides of the join are plain exchanges and Spark can split a very common line.
    shared = lines.join(cut(owners.where(F.col("owner") != F.col("last")).drop("last")), ["h", "g"])
    entry = F.struct("pos", "line", "h", "g", "words")
    # Rows equal in key and text give equal entries; the set keeps each once.
    kept = cut(shared.groupBy("doc").agg(
        F.sort_array(F.collect_set(entry)).alias("lines"), F.collect_set(F.when(F.col("owner") != F.col("doc"), F.col("owner"))).alias("owners")))

    pairs = kept.select("doc", F.col("lines").alias("later"), F.explode("owners").alias("owner"))
    both = pairs.join(kept.select(F.col("doc").alias("owner"), F.col("lines").alias("earlier")), "owner")
    found = both.select("doc", _aligned(min_words)(F.col("earlier"), F.col("later")).alias("gone")).where(F.size("gone") > 0)
    return found.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.count(F.lit(1)).alias("n_partners"))


def _edited(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """What is left of each text, with its counts."""
    left, n_lines, n_words, deleted = [], [], [], []
    for scalar, drop in zip(texts, gone):
        if not scalar.is_valid:
            for column, value in ((left, None), (n_lines, 0), (n_words, 0), (deleted, 0)):
                column.append(value)
            continue
        data = scalar.as_buffer().to_pybytes()
        n_words.append(len(data.split()))
        n_lines.append(data.count(b"\n") + 1)
        if drop.is_valid and len(drop):
            out = set(drop.values.to_pylist())
            lines = data.split(b"\n")
            deleted.append(sum(len(lines[k].split()) for k in out))
            data = b"\n".join([x for k, x in enumerate(lines) if k not in out])
        else:
            deleted.append(0)
        left.append(data)
    return pa.StructArray.from_arrays([pa.array(left, pa.binary()), *[pa.array(x, pa.int64()) for x in (n_lines, n_words, deleted)]],
                                      names=["left", "n_lines", "n_words", "deleted_words"])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text that is left, and n_lines, n_words (both before), deleted_lines, deleted_words, n_partners (earlier
    documents it was aligned with to effect). One row in, one row out."""
    rows = without(docs, [*OUTPUTS, "_key", "_hash", "_own", "_e"])
    names = rows.columns
    cuts = edits(rows, key, text, min_words).select(F.col("doc.key").alias("_key"), F.col("doc.hash").alias("_hash"), "gone", F.col("n_partners").alias("_partners"))
    met = rows.withColumn("_own", _text_hash(text)).join(
        cuts.withColumnRenamed("gone", "_gone"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_hash")), "left")
    edit = F.arrow_udf(_edited, "struct<left: binary, n_lines: bigint, n_words: bigint, deleted_words: bigint>")
    done = met.withColumn("_e", F.explode(F.array(edit(F.col(text).cast("binary"), F.col("_gone")))))
    gone = F.coalesce(F.size("_gone"), F.lit(0))
    return done.select(
        *[F.col("_e.left").cast("string").alias(n) if n == text else F.col(f"`{n}`") for n in names], "_e.n_lines", "_e.n_words",
        F.when(gone > 0, gone).otherwise(0).cast("long").alias("deleted_lines"), "_e.deleted_words", F.coalesce("_partners", F.lit(0)).cast("long").alias("n_partners"))
