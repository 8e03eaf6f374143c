"""Removal of long repeated byte strings, by difference covers and suffix buckets sorted one at a time.

Texts are bytes, and a suffix matters up to ``length`` bytes. A difference cover of period v holds, for any two places, a common
shift below v that takes both to cover places. So if two strings of ``length`` bytes are equal, a cover place at the same distance in
both starts the same length - v + 1 bytes.

1. Names. Every cover place gets a name for the bytes of its window; windows of equal bytes have equal names. Spark deals names out to parts, a task sorts one part
   at a time, and the places whose name occurs elsewhere are kept. A suffix without such a place in its first v bytes is alone and goes no further. Names only
   choose: two that are equal by chance cost work and change no result.
2. Buckets. The other suffixes go to buckets: a suffix's bucket is the smallest hash of a ``GRAM`` bytes string in its ``length`` bytes, so
   equal suffixes share a bucket and neighbours mostly do. A run of neighbours in one bucket travels as one block of text. Equal blocks are one.
3. Sorting. A task has one bucket in memory at a time and sorts its suffixes by their place before the bucket's gram and by their first v and last v bytes. Ties
   that are longer are settled by the names of the cover places that both have at the same shift. A suffix that is not alone is repeated. A bucket of over
   ``BLOCKS`` unlike blocks is too large for one task; its suffixes are counted as rows instead, with the same outcome.

Names and sorting keys are hashes from prefix sums of the bytes, of 64 bits for sorting. What shuffles is 14 bytes at most per cover place (about 1 in 13 bytes), the
blocks, and each text once. What many documents have is reduced in every task before it is sent: equal texts of a batch are named once, and a name met twice in a batch
is known to be repeated and sent once.

Defined cases: a null text counts as empty bytes and is shorter than any repeat. Texts below ``length`` bytes stay whole. Rows of equal text are copies of each other: of
those with ``length`` bytes or more nothing stays. An empty table gives an empty result. Input columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import without
from sluiceway.session import cut

LENGTH = 400
ORDER = 13  # of the cover: period ORDER**2 + ORDER + 1, ORDER + 1 places in each; a prime
GRAM = 16
PARTS = 4096  # of the names, at least; a task holds one in memory
TEXT_ID = 6  # bytes of a text_id
BLOCKS = 4096  # unlike blocks, of 2 * LENGTH bytes at most, of a bucket that a task sorts in memory
SLICE = 1 << 20  # bytes worked on at once
OUTPUTS = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept": "binary", "kept_sha256": "string"}

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
BYTES = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)


@lru_cache
def cover(order: int) -> tuple[int, np.ndarray]:
    """(period, places) of a perfect difference cover, for a prime order q: the powers of a generator of the cubic field over q whose highest
    coordinate is 0 are a line of a plane of q * q + q + 1 points, and any shift takes just one point of it to another."""
    q, period = order, order * order + order + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, line = (0, 0, 1), []  # coordinates of a power, highest first; a step multiplies by the generator
                for power in range(period):
                    if x[0] == 0:
                        line.append(power)
                    top = x[0]
                    x = ((x[1] + top * a) % q, (x[2] + top * b) % q, top * c % q)
                if len(line) == q + 1 and len({(i - j) % period for i in line for j in line}) == period:
                    return period, np.array(line)
    raise ValueError("the order of a cover must be prime")


@lru_cache
def shifts(order: int) -> np.ndarray:
    """shifts[i, j]: the least shift that takes places of residues i and j to cover places."""
    period, line = cover(order)
    inside = np.zeros(period, bool)
    inside[line] = True
    out = np.full((period, period), -1, np.int16)
    every = np.arange(period)
    for shift in range(period - 1, -1, -1):
        at = inside[(every + shift) % period]
        out[np.ix_(at, at)] = shift
    return out


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 17)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, np.uint64))]) for x in (BASE, INVERSE)]
    return _powers[0], _powers[1]


class Sums:
    """Prefix sums of a text's bytes, from which the hash of any part of it is worked out."""

    def __init__(self, data: bytes | np.ndarray):
        self.bytes = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        up, self.down = powers(len(self.bytes) + 1)
        self.sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(BYTES[self.bytes] * up[:len(self.bytes)], out=self.sums[1:])

    def keys(self, start: np.ndarray, width) -> np.ndarray:
        return mixed((self.sums[start + width] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """Keys of all parts of a width."""
        return mixed((self.sums[width:] - self.sums[:-width]) * self.down[:len(self.sums) - width])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:len(values) - (width - have)], values[width - have:]) if have < width else values


def starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def packed(values: np.ndarray, low: int, high: int) -> np.ndarray:
    """Bytes ``low`` to ``high`` of every value, lowest first."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, low:high]).ravel()


def unpacked(data: np.ndarray, low: int, high: int) -> np.ndarray:
    out = np.zeros((len(data) // (high - low), 8), np.uint8)
    out[:, low:high] = data.reshape(-1, high - low)
    return out.view("<i8").ravel()


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array of values that lie one after the other."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(data)])


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, size of each): what ``binaries`` takes."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8), np.diff(ends)


def names(length: int, order: int, parts: int):
    """Names of all cover places of batches of (text_id, text), a row (part, told, name, text, low, high) for each part that has some: 32 bits of each name
    besides its part, and for each place its text_id and its number among the cover places of its text, whose low byte and high bytes lie apart, as these are mostly 0.

    A name met once in the batch goes to its part with its place. One met more often is repeated for certain: its places are dealt out by a hash and follow in
    ``text``, ``low`` and ``high`` after those that have a name, and ``told`` tells its part of the name."""
    period, line = cover(order)
    width = length - period + 1

    def part_of(key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, ids, places, keys, waiting = set(), [], [], [], []

            def work() -> None:
                sums, base = Sums(b"".join([data for _, data in waiting])), 0
                for text_id, data in waiting:
                    at = (np.arange(0, len(data), period)[:, None] + line).ravel()
                    place = np.flatnonzero(at + width <= len(data))
                    keys.append(sums.keys(at[place] + base, width))
                    places.append(place)
                    ids.append(np.full(len(place), text_id, np.int64))
                    base += len(data)
                waiting.clear()

            size = 0
            for text_id, scalar in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text_id not in seen:
                    seen.add(text_id)
                    waiting.append((text_id, scalar.as_buffer().to_pybytes()))
                    size += len(waiting[-1][1])
                    if size > SLICE:
                        work()
                        size = 0
            work()
            key, place, text_id = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, np.uint64), (places, np.int64), (ids, np.int64)))
            by_key = np.argsort(key)  # and so by part
            key, place, text_id = key[by_key], place[by_key], text_id[by_key]
            first = starts(key)
            times = np.diff(np.r_[first, len(key)])
            many = np.repeat(times > 1, times)
            told, single = key[first[times > 1]], key[~many]
            part = np.where(many, part_of(mixed(text_id.view(np.uint64) * np.uint64(BASE) + place.astype(np.uint64))), part_of(key))
            by_part = np.argsort(part * 2 + many, kind="stable")
            n_told, n_single, n_all = (np.bincount(x, minlength=parts) for x in (part_of(told), part_of(single), part))
            own = np.flatnonzero(n_told + n_all)
            place, text_id = place[by_part], text_id[by_part]
            yield pa.RecordBatch.from_arrays([
                pa.array(own.astype(np.int32)), binaries(packed(told, 0, 4), 4 * n_told[own]), binaries(packed(single, 0, 4), 4 * n_single[own]),
                binaries(packed(text_id, 0, TEXT_ID), TEXT_ID * n_all[own]), binaries(packed(place, 0, 1), n_all[own]), binaries(packed(place, 1, 4), 3 * n_all[own])],
                names=["part", "told", "name", "text", "low", "high"])

    return run


def repeated_names(order: int):
    """(text_id, place) of the places whose name occurs elsewhere, from the rows of ``names`` sorted by part. One part is held in memory, or those of a batch."""
    period, line = cover(order)

    def found(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [[joined(b.column(k)) for b in batches] for k in range(1, 6)]
        told, name, text, low, high = (np.concatenate([data for data, _ in c]) for c in columns)
        n_told, n_single, n_all = (np.concatenate([sizes for _, sizes in columns[k]]) // width for k, width in ((0, 4), (1, 4), (3, 1)))
        part = np.concatenate([b.column(0).to_numpy() for b in batches]).astype(np.int64) << 32
        number = unpacked(low, 0, 1) | unpacked(high, 1, 4)
        text_id, place = unpacked(text, 0, TEXT_ID), number // len(line) * period + line[number % len(line)]
        named = np.arange(len(place)) - np.repeat(np.cumsum(n_all) - n_all, n_all) < np.repeat(n_single, n_all)
        key = np.r_[np.repeat(part, n_single) | unpacked(name, 0, 4), np.repeat(part, n_told) | unpacked(told, 0, 4)]
        by_key = np.argsort(key)
        first = starts(key[by_key])
        size = np.diff(np.r_[first, len(key)])
        where = np.r_[np.flatnonzero(named), np.full(len(key) - int(named.sum()), -1)][by_key]  # of a name: its place; -1: it is told
        lead = np.repeat(where[first], size)
        ids, at = np.r_[text_id, -1], np.r_[place, -1]
        differ = (where < 0) | (ids[where] != ids[lead]) | (at[where] != at[lead])
        repeated = np.repeat(np.add.reduceat(differ.astype(np.int64), first) > 0, size) if len(key) else differ
        keep = ~named
        keep[where[repeated & (where >= 0)]] = True
        return pa.RecordBatch.from_arrays([pa.array(text_id[keep]), pa.array(place[keep].astype(np.int32))], names=["text_id", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            begins = int(np.searchsorted(part, part[-1]))
            if part[-1] != last and (waiting or begins):
                yield found([*waiting, batch.slice(0, begins)])
                waiting = []
            last = part[-1]
            waiting.append(batch.slice(begins))
        if waiting:
            yield found(waiting)

    return run


def suffix_runs(places: np.ndarray, n: int, length: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of suffixes that have a repeated cover place in their first ``period`` bytes."""
    period, _ = cover(order)
    places = places[places + (length - period + 1) <= n]
    low, high = np.maximum(0, places - period + 1), np.minimum(places, n - length)
    low, high = low[low <= high], high[low <= high]
    if not len(low):
        return low, high
    new = np.r_[True, low[1:] > high[:-1] + 1]
    return low[new], high[np.r_[np.flatnonzero(new)[1:] - 1, len(high) - 1]]


class Blocks:
    """The suffixes of some runs of text, as blocks of neighbours that share bucket and gram."""

    def __init__(self, runs: list[tuple[int, int, int, bytes]], length: int):
        """``runs``: text_id, text_id2, first place, bytes."""
        self.data = b"".join([r[3] for r in runs])
        sizes = np.array([len(r[3]) for r in runs])
        base = np.cumsum(sizes) - sizes
        sums, n, span = Sums(self.data), len(self.data), length - GRAM + 1
        grams = sums.windows(GRAM)
        least = lowest(grams, span)
        run = np.repeat(np.arange(len(runs)), sizes - length + 1)
        at = np.arange(len(run)) + np.repeat(base - np.cumsum(sizes - length + 1) + (sizes - length + 1), sizes - length + 1)
        # Grams that are the least of some window, by value and place; a suffix's gram is the first of its value from its place on.
        pad = np.zeros(span - 1, np.uint64)
        found = np.flatnonzero(grams == ~lowest(~np.concatenate([pad, least, pad]), span))
        values, number = np.unique(grams[found], return_inverse=True)
        order = np.argsort(number * n + found)
        sorted_places = (number * n + found)[order]
        gram = found[order][np.searchsorted(sorted_places, np.searchsorted(values, least[at]) * n + at)]
        first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (run[1:] != run[:-1])]) if len(at) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(at)] - 1
        self.start, self.end = at[first], at[last] + length
        self.bucket, self.gram = least[at[first]], gram[first] - at[first]
        self.digest = mixed(sums.keys(self.start, self.end - self.start) + self.gram.astype(np.uint64) * np.uint64(BASE) + (self.end - self.start).astype(np.uint64))
        of = run[first]
        self.text_id, self.text_id2, place = (np.array([r[k] for r in runs], np.int64) for k in range(3))
        self.text_id, self.text_id2 = self.text_id[of], self.text_id2[of]
        self.place = place[of] + self.start - base[of]


def text_blocks(length: int, order: int, pieces: bool, columns: list[str]):
    """Blocks of batches of texts and their repeated cover places: rows (bucket, digest, text_id, text_id2, place), or, for ``pieces``, the distinct ones
    of a batch with their text: (bucket, digest, text_id, place, gram, many, piece). ``many``: met at several places of the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, found, runs, size = set(), [], [], 0
            text_ids, others, texts, places = (batch.column(columns.index(c)) for c in ("text_id", "text_id2", "_text", "places"))
            for text_id, other, scalar, own in zip(text_ids.to_pylist(), others.to_pylist(), texts, places):
                if (text_id, other) in seen:
                    continue
                seen.add((text_id, other))
                data = scalar.as_buffer().to_pybytes()
                for low, high in zip(*(x.tolist() for x in suffix_runs(own.values.to_numpy(), len(data), length, order))):
                    runs.append((text_id, other, low, data[low:high + length]))
                    size += high + length - low
                if size > SLICE:
                    found.append(Blocks(runs, length))
                    runs, size = [], 0
            if runs:
                found.append(Blocks(runs, length))
            if not found:
                continue
            bucket, digest, text_id, text_id2, place, gram = (np.concatenate([getattr(b, n) for b in found]) for n in ("bucket", "digest", "text_id", "text_id2", "place", "gram"))
            if not pieces:
                yield pa.RecordBatch.from_arrays([signed(bucket), signed(digest), pa.array(text_id), pa.array(text_id2), pa.array(place)],
                                                 names=["bucket", "digest", "text_id", "text_id2", "place"])
                continue
            by = np.lexsort((place, text_id, digest, bucket))
            first = np.flatnonzero(np.r_[True, (bucket[by][1:] != bucket[by][:-1]) | (digest[by][1:] != digest[by][:-1])])
            many = np.diff(np.r_[first, len(by)]) > 1
            take = by[first]
            which = np.repeat(np.arange(len(found)), [len(b.start) for b in found])[take]
            inside = take - (np.cumsum([len(b.start) for b in found]) - [len(b.start) for b in found])[which]
            texts_of = [found[w].data[found[w].start[i]:found[w].end[i]] for w, i in zip(which.tolist(), inside.tolist())]
            yield pa.RecordBatch.from_arrays([
                signed(bucket[take]), signed(digest[take]), pa.array(text_id[take]), pa.array(place[take]), pa.array(gram[take].astype(np.int32)), pa.array(many),
                pa.array(texts_of, pa.binary())], names=["bucket", "digest", "text_id", "place", "gram", "many", "piece"])

    return run


def bucket_suffixes(pieces: list[tuple], length: int, order: int):
    """(block of each suffix, its place in the block, its place before the gram, sums of all bytes, its place in these, its residue in the cover)."""
    period, _ = cover(order)
    sums = Sums(b"".join([p[6] for p in pieces]))
    sizes = np.array([len(p[6]) for p in pieces])
    counts = sizes - length + 1
    block = np.repeat(np.arange(len(pieces)), counts)
    inside = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    place, gram = (np.array([p[k] for p in pieces], np.int64) for k in (3, 4))
    return block, inside, gram[block] - inside, sums, inside + (np.cumsum(sizes) - sizes)[block], (place[block] + inside) % period


def sort_bucket(pieces: list[tuple], length: int, order: int) -> np.ndarray:
    """Which suffixes of a bucket of unlike blocks are in several of them."""
    period, _ = cover(order)
    width = length - period + 1
    block, inside, before, sums, at, residue = bucket_suffixes(pieces, length, order)
    key = mixed(sums.keys(at, period) + np.uint64(3) * sums.keys(at + length - period, period) + before.astype(np.uint64) * np.uint64(BASE))
    here = np.argsort(key)
    key = key[here]
    shift, out = shifts(order), np.zeros(len(block), bool)
    while len(here):
        first = starts(key)
        size = np.diff(np.r_[first, len(key)])
        lead = np.repeat(here[first], size)
        step = shift[residue[here], residue[lead]].astype(np.int64)
        same = sums.keys(at[here] + step, width) == sums.keys(at[lead] + step, width)
        twice = np.repeat(np.add.reduceat(same.astype(np.int64), first) > 1, size)
        out[here[same & twice]] = True
        here, key = here[~same], key[~same]  # ties with another name: once more, among themselves
    return out


def sorted_buckets(length: int, order: int, most: int, whole: bool):
    """From pieces sorted by bucket and digest, one bucket in memory at a time. ``whole``: (bucket, digest, runs) of the repeated suffixes of every block, as first
    and last place in the block. Otherwise, for buckets of over ``most`` blocks only: (bucket, digest, before, key, many, inside), a row a suffix."""
    def suffix_rows(pieces: list[tuple]) -> pa.RecordBatch:
        block, inside, before, sums, at, _ = bucket_suffixes(pieces, length, order)
        own = [np.array([p[k] for p in pieces])[block] for k in (0, 1, 5)]
        return pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(before), signed(sums.keys(at, length)), pa.array(own[2]), pa.array(inside)],
                                          names=["bucket", "digest", "before", "key", "many", "inside"])

    def block_runs(pieces: list[tuple]) -> Iterator[tuple]:
        counts = [len(p[6]) - length + 1 for p in pieces]
        repeated = sort_bucket(pieces, length, order) if len(pieces) > 1 else np.zeros(counts[0], bool)
        start = 0
        for piece, count in zip(pieces, counts):
            mask = np.zeros(count + 2, np.int8)
            mask[1:-1] = piece[5] | repeated[start:start + count]
            start += count
            edges = np.flatnonzero(np.diff(mask))
            if len(edges):
                edges[1::2] -= 1
                yield piece[0], piece[1], edges.tolist()

    def runs_batch(rows: list[tuple]) -> pa.RecordBatch:
        bucket, digest, runs = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(digest, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["bucket", "digest", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple] = []
        large, done = False, []

        def finish() -> Iterator[pa.RecordBatch]:
            if whole and pieces and not large:
                done.extend(block_runs(pieces))
            if not whole and large and pieces:
                yield suffix_rows(pieces)
            pieces.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if pieces and row[0] != pieces[-1][0]:
                    yield from finish()
                    large = False
                if pieces and row[1] == pieces[-1][1]:  # one block, met by several tasks
                    pieces[-1] = (*pieces[-1][:5], pieces[-1][5] or row[5] or row[2:4] != pieces[-1][2:4], pieces[-1][6])
                    continue
                if len(pieces) == most:
                    large = True
                    if not whole:
                        yield suffix_rows(pieces)
                    pieces.clear()
                pieces.append(row)
            if whole:
                yield runs_batch(done)
                done.clear()
        yield from finish()
        if whole:
            yield runs_batch(done)

    return run


def large_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, digest, runs) of the suffixes of large buckets: counted by key, summed up in each task first."""
    group = ["bucket", "before", "key"]
    twice = rows.groupBy(*group).agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.max("many").alias("many")).where("a <> b or many")
    # A block met at several places is repeated itself; its suffixes make those of other blocks repeated.
    there = rows.join(twice.select(*group), group).groupBy("bucket", "digest").agg(F.collect_set("inside").alias("inside"))
    return there.select("bucket", "digest", F.flatten(F.transform("inside", lambda i: F.array(i, i))).cast("array<int>").alias("runs"))


def remove(docs: DataFrame, length: int = LENGTH, order: int = ORDER, text: str = "text", outputs: tuple[str, ...] = tuple(OUTPUTS), most: int = BLOCKS) -> DataFrame:
    """``docs`` without the bytes covered by a string of ``length`` bytes that also starts elsewhere: n_bytes, n_removed, n_spans (maximal removed runs), kept
    (the remaining bytes) and kept_sha256, or those of ``outputs``. One row in, one row out. ``length`` must be twice the cover's period at least.
    Texts are shuffled once if the caller keeps all columns of ``docs`` besides ``text``; what is selected later prunes the last join's shuffle, not the first's."""
    period, _ = cover(order)
    if length < 2 * period:
        raise ValueError(f"a repeat must have {2 * period} bytes or more")
    own = without(docs, [*outputs, "text_id", "text_id2", "_text", "places", "spans"])
    # The text travels as bytes only, null or not, and is made of them again.
    rest = [F.col(f"`{c}`") for c in own.columns if c.lower() != text.lower()]
    data = F.coalesce("_text", F.lit(b""))
    texts = own.select(*rest, F.col(text).cast("binary").alias("_text")).withColumns(
        {"text_id": F.xxhash64(data).bitwiseAND(F.lit(2 ** (8 * TEXT_ID) - 1)), "text_id2": F.xxhash64(F.lit(1), data)})
    parts = max(PARTS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = texts.where(F.length("_text") >= length).select("text_id", "_text").mapInArrow(
        names(length, order, parts), "part int, told binary, name binary, text binary, low binary, high binary")
    places = named.repartition("part").sortWithinPartitions("part").mapInArrow(repeated_names(order), "text_id long, place int")
    known = cut(places.groupBy("text_id").agg(F.sort_array(F.collect_set("place")).alias("places")))

    # All columns are asked for, so that this join and the last one share one shuffle of the texts.
    met = texts.join(known, "text_id")
    rows = met.mapInArrow(text_blocks(length, order, False, met.columns), "bucket long, digest long, text_id long, text_id2 long, place long")
    kinds = "bucket long, digest long, text_id long, place long, gram int, many boolean, piece binary"
    pieces = met.mapInArrow(text_blocks(length, order, True, met.columns), kinds).repartition("bucket").sortWithinPartitions("bucket", "digest")
    small = pieces.mapInArrow(sorted_buckets(length, order, most, True), "bucket long, digest long, runs array<int>")
    large = pieces.mapInArrow(sorted_buckets(length, order, most, False), "bucket long, digest long, before long, key long, many boolean, inside long")
    runs = small.unionAll(large_buckets(large)).withColumn("run", F.explode(F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda i: F.struct(
        F.get("runs", 2 * i).alias("a"), F.get("runs", 2 * i + 1).alias("b")))))
    spans = rows.join(runs.select("bucket", "digest", "run.*"), ["bucket", "digest"]).select(
        "text_id", "text_id2", (F.col("place") + F.col("a")).alias("start"), (F.col("place") + F.col("b") + length).alias("end"))
    copies = texts.groupBy("text_id", "text_id2").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("_text")).cast("long").alias("end"))
    copies = copies.where((F.col("n") > 1) & (F.col("end") >= length)).select("text_id", "text_id2", F.lit(0).cast("long").alias("start"), "end")
    found = spans.unionByName(copies).groupBy("text_id").agg(F.collect_set(F.struct("text_id2", "start", "end")).alias("spans"))

    struct = "struct<" + ", ".join(f"{n}: {OUTPUTS[n]}" for n in outputs) + ">"
    done = texts.join(found, "text_id", "left").withColumn("_fields", F.explode(F.array(F.arrow_udf(_cut_out(outputs), struct)(data, "text_id2", "spans"))))
    return done.select(*[F.col("_text").cast(c.dataType).alias(c.name) if c.name.lower() == text.lower() else F.col(f"`{c.name}`") for c in own.schema], *[F.col(f"_fields.{n}").alias(n) for n in outputs])


def _cut_out(outputs: tuple[str, ...]):
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}

    def run(texts: pa.Array, ids: pa.Array, spans: pa.Array) -> pa.Array:
        out: dict[str, list] = {n: [] for n in outputs}
        for scalar, own, found in zip(texts, ids.to_pylist(), spans.to_pylist()):
            data, at, kept, n_spans = scalar.as_buffer().to_pybytes(), 0, [], 0
            last = -1
            for start, end in sorted((s["start"], s["end"]) for s in found or () if s["text_id2"] == own):
                if start > last:
                    n_spans += 1
                    kept.append(data[at:start])
                last = at = max(last, end)
            kept.append(data[at:])
            left = b"".join(kept)
            values = {"n_bytes": len(data), "n_removed": len(data) - len(left), "n_spans": n_spans, "kept": left}
            for n in outputs:
                out[n].append(hashlib.sha256(left).hexdigest() if n == "kept_sha256" else values[n])
        return pa.StructArray.from_arrays([pa.array(v, kinds[OUTPUTS[n]]) for n, v in out.items()], names=list(out))

    return run
