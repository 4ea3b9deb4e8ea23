"""Exact n-gram Jaccard join, as components.

Word shingles under the Jaccard distance are a metric space, joined in regions around pivots:

1. *First regions.* In text, two unrelated documents are at a distance near 1 from each other and from
   every sampled pivot document, so windows of the triangle inequality around pivot documents alone would
   copy every document to every region. The first split therefore takes a coarser cover that is exact for
   the same radius: the shingle universe is cut into ``M`` parts, where ``M`` exceeds the largest symmetric
   difference ``e`` that two linked sets of that size can have, so linked sets agree on one part at least. A
   document lies in the region of each of its parts; those near the border of a size class are copied to the
   next class. Shingles of common lines, found by a sketch of counts over all documents, are left out of the
   parts, which keeps regions small and loses nothing.
2. *Pivots within regions.* Each region takes a pivot document, every other one is compared with it exactly,
   and linked ones join its cell. Pairs of one cell need no further test, and most regions are one cell.
3. *Parity bits.* Sets that differ in many shingles differ in many parities of their hashes as well, so most pairs that met by
   chance are ruled out by some bits a shingle, before a set is read. In a mixed region of up to ``SMALL`` rows all pairs of
   different cells are judged so, and the few that are left are compared exactly.
4. *Recursion.* Mixed regions that are larger, or where more than ``LEFT`` pairs a row are left, are gathered into groups that
   have no region in common; there distances do vary.
   A group of more than ``BLOCK`` shingles is split among pivots into Voronoi regions: a document goes to its nearest
   pivot and, by the triangle inequality, to every pivot that is at most twice the radius farther, so that two linked
   documents share a region. Documents ``HOME`` or farther from every pivot have a region of their own, and one farther
   than ``HOME`` plus the radius from a pivot cannot link into its region. Regions are split again while that makes them
   smaller. In what is left every document outside the largest cell is compared exactly with all documents of the region,
   block by block; only what connects two cells is kept.

Sizes rule out pairs before a comparison. Of a group's pairs no more than ``LEFT`` a document are enumerated as rows, a
region of any size is streamed from sorted shuffle partitions, and a group of any size is dealt into blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.graph import components
from quire.llm.tables import dropped, free_name, id_key, is_whole, mapped, written
from quire.llm.tokens import distinct_sets, mix, pieces, shingles, words

#: Shingles in a block of a group, pivots of a split, and levels of recursion.
BLOCK, PIVOTS, DEPTH = 150_000, 16, 6
#: Distance from which on a document does not belong to a pivot.
HOME = 0.5
#: Rows of a region up to which one task compares all its pairs by parity bits, and pairs a row beyond which it has too many left.
SMALL, LEFT = 4096, 4
#: Cells of the sketch of shingle counts, and the pieces in which it is added up.
CELLS, SEGMENTS = 1 << 20, 64


@lru_cache(maxsize=None)
def _level(j: int, percent: int) -> tuple[int, int, int]:
    """Largest set size, errors allowed between linked sets, and number of parts of size class ``j``."""
    top = 1
    for _ in range(j):
        top = max(top + 1, int(top * (1 + 2 * (100 - percent) / 100)))
    errors = (100 - percent) * 2 * top // (100 + percent)
    least = max(1, top * percent // 100 * percent // 100)
    parts = errors + 1
    while parts < 2 * errors + 2:
        empty = math.exp(-least / parts)
        if parts * (1 - empty) - 3 * math.sqrt(parts * empty * (1 - empty)) >= errors + 1:
            break
        parts += 1
    return top, errors, parts


def _levels_of(sizes: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(class, indexes of the sets that take part in it); sets near the top of a class also enter the next."""
    out, j, below = [], 0, 0
    most = int(sizes.max()) if len(sizes) else 0
    while below < most:
        top = _level(j, percent)[0]
        # own class: below < size <= top; a smaller set joins where it can link with one of size below + 1
        own = np.flatnonzero((sizes > 0) & (sizes <= top) & (100 * sizes >= percent * (below + 1)))
        if len(own):
            out.append((j, own))
        below, j = top, j + 1
    # the largest sets have no class above them in this batch, but may have in others
    for _ in range(2):
        own = np.flatnonzero(100 * sizes >= percent * (below + 1))
        if len(own):
            out.append((j, own))
        below, j = _level(j, percent)[0], j + 1
    return out


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for p in pieces(column):
        row, _, value = shingles(words(p), k)
        yield p.first, p.rows, *distinct_sets(row, value, p.rows)


def _counts(k: int):
    """Documents of each cell of a fixed sketch of all shingles, from one partition, in compressed segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, _, value, _ in _sets(batch.column(1), k):
                total += np.bincount((value & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        yield _segments(range(SEGMENTS), np.split(total, SEGMENTS))

    return run


def _segments(numbers, totals) -> pa.RecordBatch:
    packed = [zlib.compress(t.astype(np.int64).tobytes(), 1) for t in totals]
    return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), pa.array(packed, pa.binary())], names=["segment", "packed"])


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // SEGMENTS, np.int64)
    for raw in table.column("packed"):
        total += np.frombuffer(zlib.decompress(raw.as_py()), np.int64)
    return pa.Table.from_batches([_segments([table.column("segment")[0].as_py()], [total])])


def frequent_cells(docs: DataFrame, k: int) -> np.ndarray:
    """Flags of the sketch's cells that hold a shingle of far more documents than an average cell has.

    Counts cover all documents; the sketch has the same size whatever their number, and it is added up in two steps.
    """
    parts = mapped(docs, _counts(k), "segment int, packed binary").withColumn("salt", F.pmod(F.xxhash64("packed"), F.lit(16)))
    for keys in (["segment", "salt"], ["segment"]):
        parts = parts.groupBy(*keys).applyInArrow(_added, "segment int, packed binary")
    rows = sorted(parts.select("segment", "packed").collect())
    if not rows:
        return np.zeros(CELLS, bool)
    total = np.concatenate([np.frombuffer(zlib.decompress(bytes(r["packed"])), np.int64) for r in rows])
    mean = total.mean()
    return total > mean + 6 * mean**0.5 + 30


def _part_keys(k: int, percent: int, frequent: np.ndarray):
    """Keys of the parts of each document's set.

    Frequent shingles (of common lines) are left out of the parts: what two linked sets differ by without them is
    no more than with them, so they still agree on a part that is not empty if one of them has more parts than
    errors. Documents that have not, being made of common lines, take part with their whole sets among themselves.

    Of its keys a document gives one more than the errors it can have, in an order of all keys: what it has before the first
    key that it shares with a linked document is no more than its errors, so both give that key. Parts of many shingles come
    first, so that documents seldom meet by a single phrase.
    """
    schema = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("n", pa.int32())])
    packed = np.packbits(frequent)

    def keys_of(row: np.ndarray, value: np.ndarray, parts: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, row, place among the row's keys: those of more shingles first, then by hash)."""
        if not len(row):
            return np.zeros(0, np.uint64), row, row
        with np.errstate(over="ignore"):
            part = ((value >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
            begin = np.flatnonzero(new)
            key = mix(np.add.reduceat(mix(value), begin) + mix(part[begin] + np.uint64(salt)))
        held = np.minimum(np.diff(np.append(begin, len(row))), 15).astype(np.uint64)
        order = np.lexsort(((key >> np.uint64(4)) | ((np.uint64(15) - held) << np.uint64(60)), row[begin]))
        key, where = key[order], row[begin][order]
        return key, where, np.arange(len(where)) - np.searchsorted(where, where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(packed).astype(bool)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, rows, row, value, at in _sets(batch.column(1), k):
                own = ids[first : first + rows]
                sizes = np.diff(at)
                rare = ~common[(value & np.uint64(CELLS - 1)).astype(np.int64)]
                for j, who in _levels_of(sizes, percent):
                    top, _, parts = _level(j, percent)
                    # by how many shingles a set of this class can differ from a linked one of the class
                    errors = (100 - percent) * (sizes + np.minimum(top, sizes * 100 // percent)) // (100 + percent)
                    picked = np.zeros(rows, bool)
                    picked[who] = True
                    use = picked[row]
                    key, where, place = keys_of(row[use & rare], value[use & rare], parts, (2 * j + 2) << 40)
                    picked &= np.bincount(where, minlength=rows) <= errors
                    use = picked[row]
                    more, there, after = keys_of(row[use], value[use], parts, (2 * j + 3) << 40)
                    thin = np.flatnonzero(picked & (np.bincount(there, minlength=rows) <= errors))
                    first, second = place <= errors[where], after <= errors[there]
                    key = np.concatenate([key[first], more[second], np.full(len(thin), mix(np.array([j + 1], np.uint64))[0])])
                    where = np.concatenate([where[first], there[second], thin])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own[where]), pa.array(sizes[where].astype(np.int32))], schema=schema)

    return run


def _parities(k: int):
    """Each set and its parity bits: bit ``i`` of ``m`` tells whether an odd number of shingles has the hash ``i`` modulo ``m``.

    ``m`` is a power of two, at least the set's size up to 2^16. Two sets' bits differ in no more places than the sets do.
    """
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, rows, row, value, at in _sets(batch.column(1), k):
                sizes = np.diff(at)
                m = 1 << np.clip(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 6, 16)
                begin = np.concatenate([[0], np.cumsum(m)])
                place = begin[row] + (value & (m[row] - 1).astype(np.uint64)).astype(np.int64)
                odd = np.packbits((np.bincount(place, minlength=begin[-1]) & 1).astype(bool), bitorder="little")
                bits = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((begin // 8).astype(np.int32)), pa.py_buffer(odd)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, rows), pa.array(sizes.astype(np.int32)), bits, lists], schema=schema)

    return run


def _folded(bits: bytes, size: int) -> np.ndarray:
    """Parity bits in 64-bit words, for a smaller modulus of ``size`` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def _alike(percent: int):
    """Pairs ``(id, pivot)`` whose parity bits do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, other_n = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            most = (100 - percent) * (n + other_n) // (100 + percent)
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                size = min(len(x), len(y))
                keep[i] = np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum() <= most[i]
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _candidates(percent: int):
    """Pairs of different cells of a region (rows sorted by region) that parity bits do not rule out.

    A region with more than ``LEFT`` of them a row gives one row without a pair instead.
    """
    names, left = ["part", "id", "pivot"], LEFT

    def pairs(ids: list[int], sizes: list[int], cells: list[int], bits: list[bytes]) -> set[tuple[int, int]] | None:
        size = min(map(len, bits))
        own = np.stack([_folded(x, size) for x in bits])
        n, cell = np.array(sizes, np.int64), np.array(cells)
        out: set[tuple[int, int]] = set()
        for i in range(len(ids) - 1):
            differ = np.bitwise_count(own[i + 1 :] ^ own[i]).sum(axis=1, dtype=np.int64)
            for j in np.flatnonzero((differ <= (100 - percent) * (n[i] + n[i + 1 :]) // (100 + percent)) & (cell[i + 1 :] != cell[i])).tolist():
                a, b = ids[i], ids[i + 1 + j]
                out.add((max(a, b), min(a, b)))
            if len(out) > left * len(ids):
                return None
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, ([], [], [], [])

        def done() -> pa.RecordBatch:
            got = pairs(*held)
            rows = [(part, None, None)] if got is None else [(part, a, b) for a, b in got]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=names)

        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if held[0]:
                        yield done()
                    part, held = p, ([], [], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if held[0]:
            yield done()

    return run


def _set_sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, _, _, at in _sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(np.diff(at).astype(np.int64))], names=["doc_id", "n_shingles"])

    return run


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(id, pivot)`` with both sizes and the exact number of shared shingles; ids compare as given."""
    left = sets.select("id", F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("y"))
    return pairs.join(left, "id").join(right, "pivot").select(
        "id", "pivot",
        F.size("x").cast("long").alias("nx"),
        F.size("y").cast("long").alias("ny"),
        F.size(F.array_intersect("x", "y")).cast("long").alias("both"),
    )


def _blocks(percent: int):
    """Links between the pivots and the documents of each block (rows sorted by block), as a spanning forest."""

    def links(pivots: list[tuple], others: list[tuple]) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        cells = np.array([o[1] for o in others])
        sizes = np.array([len(o[2]) for o in others])
        flat = np.concatenate([o[2] for o in others])
        order = np.argsort(flat, kind="stable")
        value = flat[order]
        owner = np.repeat(np.arange(len(others)), sizes)[order]
        out = []
        for name, cell, shingle in pivots:
            lo, hi = np.searchsorted(value, shingle, "left"), np.searchsorted(value, shingle, "right")
            size = hi - lo
            index = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            both = np.bincount(owner[index], minlength=len(others))
            for j in np.flatnonzero((100 * both >= percent * (len(shingle) + sizes - both)) & (cells != cell)).tolist():
                a, b = find(cell), find(int(cells[j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((name, others[j][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def done() -> pa.RecordBatch:
            got = links(held[1], held[0]) if held[0] and held[1] else []
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            pivot, ids, cells, sets = (batch.column(i) for i in range(3, 7))
            flat, at = sets.values.to_numpy(zero_copy_only=False), sets.offsets.to_numpy()
            for i, (p, x, c) in enumerate(zip(pivot.to_pylist(), ids.to_pylist(), cells.to_pylist(), strict=True)):
                if keys[i] != key:
                    if key is not None:
                        yield done()
                    key, held = keys[i], ([], [])
                held[p].append((x, c, flat[at[i] : at[i + 1]].copy()))
        if key is not None:
            yield done()

    return run


def _regions(docs: DataFrame, percent: int, made: list[DataFrame] | None = None) -> DataFrame:
    """``docs(g, id, cell, shingles)`` with each large group ``g`` split into Voronoi regions around pivots, recursively.

    A split is kept where its largest region has at most three quarters of the group's shingles and all its regions
    at most twice; a group that pivots do not part stays whole. Groups of a single cell, already connected, are left out.
    Tables that the result reads are added to ``made``.
    """
    size = F.sum(F.size("shingles").cast("long"))
    leaves, now = [], docs
    made = [] if made is None else made
    for depth in range(DEPTH):
        stat = now.groupBy("g").agg(size.alias("total"), F.min("cell").alias("lo"), F.max("cell").alias("hi")).where("lo <> hi")
        large = stat.where(F.col("total") > BLOCK).select("g", "total")
        if large.isEmpty():
            break
        leaves.append(now.join(stat.where(F.col("total") <= BLOCK).select("g"), "g"))
        mark = F.xxhash64("id", F.lit(depth))
        big = now.join(large, "g").withColumn("mark", mark).withColumn("slot", F.pmod(F.xxhash64("mark"), F.lit(PIVOTS)))
        heads = big.groupBy("g", "slot").agg(F.min("mark").alias("mark"))
        heads = big.join(heads, ["g", "slot", "mark"]).groupBy("g", "slot").agg(F.first("shingles").alias("y"))  # copies of an id have one set
        around = heads.groupBy("g").agg(F.collect_list(F.struct("slot", "y")).alias("pivots"))  # PIVOTS at most

        def distance(p):
            both = F.size(F.array_intersect("shingles", p["y"])).cast("double")
            return F.struct((1 - both / (F.size("shingles") + F.size(p["y"]) - both)).alias("far"), p["slot"].alias("slot"))

        far = big.join(around, "g").select("g", "total", "id", "cell", "shingles", F.transform("pivots", distance).alias("far"))
        radius = (100 - percent) / 100 + 1e-9
        near = F.filter("far", lambda x: (x["far"] < HOME + radius) & (x["far"] <= F.array_min("far")["far"] + 2 * radius))["slot"]
        rest = F.when(F.array_min("far")["far"] >= HOME, F.array(F.lit(PIVOTS).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
        to = F.explode(F.concat(near, rest)).alias("to")
        dealt = written(far.select("g", "total", "id", "cell", "shingles", to).withColumn("to", F.xxhash64("g", F.lit(depth), "to")))
        made.append(dealt)
        parts = dealt.groupBy("g", "total", "to").agg(size.alias("part"))
        parted = parts.groupBy("g", "total").agg(F.max("part").alias("most"), F.sum("part").alias("all")).where("4 * most <= 3 * total and all <= 2 * total").select("g")
        whole = large.join(parted, "g", "left_anti").select("g")
        leaves.append(now.join(whole, "g"))
        now = dealt.join(parted, "g").select(F.col("to").alias("g"), "id", "cell", "shingles")
    for leaf in leaves:
        now = now.unionByName(leaf)
    return now


def _group_links(left: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links between documents of different cells of a group, and the tables that they are read from.

    Groups are split into regions first. Documents outside a region's largest cell are pivots, each compared exactly
    with every document of the region through an inverted index. Pivots and documents of a region are dealt into blocks
    of about ``BLOCK`` shingles, and each pair of blocks is one piece of work, whatever the region's size. Of the links
    only a forest comes out.
    """
    docs = left.select("id", "cell").distinct().join(groups.select(F.col("node").alias("id"), F.col("component").alias("g")), "id").join(sets, "id")
    made = [written(docs.select("g", "id", "cell", "shingles"))]
    docs = _regions(made[0], percent, made)
    by_cell = docs.groupBy("g", "cell").agg(F.count("*").alias("docs"), F.sum(F.size("shingles").cast("long")).alias("size"))
    stat = by_cell.groupBy("g").agg(F.max(F.struct("docs", "cell")).alias("top"), F.sum("size").alias("size"))
    parts = lambda: F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    docs = docs.join(stat.select("g", F.col("top.cell").alias("main"), parts().alias("parts")), "g")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    pivots = docs.where("cell <> main").select("g", own.alias("p"), F.explode(every).alias("q"), F.lit(1).alias("pivot"), "id", "cell", "shingles")
    others = docs.select("g", F.explode(every).alias("p"), own.alias("q"), F.lit(0).alias("pivot"), "id", "cell", "shingles")
    dealt = pivots.unionByName(others).repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")
    return mapped(dealt, _blocks(percent), "a long, b long"), made


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, component_id)`` of documents with a link to another one.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``k``-word shingles
    (A-Z lower-cased; a shorter text is one shingle). Null and empty texts have no set and no link. A null
    ``doc_id`` is no document to link with; repeated ``doc_id`` rows count as one document with the union of their
    links. An id that is no whole number stands for its hash here. Copies have distance 0 and link. Columns other
    than ``doc_id`` and ``text`` are not read. An empty table gives an empty one. ``percent`` is 50 to 100.
    """
    if not 50 <= percent <= 100 or k < 1:
        raise ValueError("percent must be 50 to 100 and k positive")
    docs = docs.select(id_key(docs).alias("id"), "text").where("id is not null and text is not null")
    keys = mapped(docs, _part_keys(k, percent, frequent_cells(docs, k)), "part long, id long, n int")
    by_part = Window.partitionBy("part").orderBy("id")
    regions = written(
        keys.select(
            "part", "id", "n",
            F.lag("id").over(by_part).alias("before"),
            F.lead("id").over(by_part).alias("after"),
            F.first("id").over(by_part).alias("first"),
            F.first("n").over(by_part).alias("first_n"),
        )
        .where("before <> first or after <> id or before < id")
        .select("part", "id", "n", "first", "first_n")
    )
    near = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    linked = (100 * F.col("both") >= percent * (F.col("nx") + F.col("ny") - F.col("both")))

    # what parity bits leave of the pairs with a region's first document is compared exactly
    seen = written(mapped(docs.join(regions.select("id").distinct(), "id"), _parities(k), "id long, n int, bits binary, shingles array<long>"))
    bits, sets = seen.select("id", "n", "bits"), seen.select("id", "shingles")
    pairs = regions.where((F.col("id") != F.col("first")) & near(F.col("n"), F.col("first_n"))).select("id", F.col("first").alias("pivot")).distinct()
    both = pairs.join(bits.select("id", F.col("n").alias("x"), F.col("bits").alias("xs")), "id").join(bits.select(F.col("id").alias("pivot"), F.col("n").alias("y"), F.col("bits").alias("ys")), "pivot")
    alike = written(mapped(both.select("id", "pivot", "x", "y", "xs", "ys"), _alike(percent), "id long, pivot long").distinct())
    tested = written(_tested(alike, sets, percent).where(linked).select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    dropped(alike)
    cells = written(components(tested))

    # regions whose other documents, beside the pivot, are of more than one cell
    label = cells.select(F.col("node").alias("id"), F.col("component").alias("cell"))
    now = regions.where("id <> first").select("part", "id").distinct().join(label, "id", "left").withColumn("cell", F.coalesce("cell", "id"))
    mixed = now.groupBy("part").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("part", "rows")
    left = written(now.join(mixed, "part").select("part", "rows", "id", "cell"))
    dropped(regions)
    dropped(cells)
    small = left.where(F.col("rows") <= SMALL).join(bits, "id").select("part", "id", "n", "cell", "bits")
    found = written(mapped(small.repartition("part").sortWithinPartitions("part"), _candidates(percent), "part long, id long, pivot long"))
    alike = written(found.where("id is not null").select("id", "pivot").distinct())
    large = written(left.where(F.col("rows") > SMALL).select("part", "id", "cell").unionByName(left.join(found.where("id is null").select("part"), "part").select("part", "id", "cell")))
    for table in (left, found):
        dropped(table)

    # the pairs that are left, and regions that are too large or have too many of them, gathered into groups that share none
    links = _tested(alike, sets, percent).where(linked).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    made = []
    if not large.isEmpty():
        heads = large.groupBy("part").agg(F.min("id").alias("head"))
        groups = written(components(large.join(heads, "part").select(F.col("id").alias("a"), F.col("head").alias("b"))))
        more, made = _group_links(large, groups, sets, percent)
        links, made = links.unionByName(more), [groups, *made]
    cells = components(tested.unionByName(links))
    for table in (alike, large, seen, tested, *made):
        dropped(table)
    return cells.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def jaccard_join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` (set size), ``component_id`` (smallest linked ``doc_id``).

    Documents without links, or without words, are their own component; a null ``doc_id`` has a null one. ``doc_id``
    may have any type, and ``component_id`` has the same. See ``jaccard_components`` for ties, repeated rows and empty
    tables.
    """
    found = jaccard_components(docs, k, percent)
    sizes = mapped(docs.select("doc_id", "text"), _set_sizes(k), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long")
    if is_whole(docs.schema["doc_id"].dataType):
        label = found.select("doc_id", "component_id")
    else:  # from hashes back to ids
        names = found.join(docs.select(id_key(docs).alias("key"), F.col("doc_id").alias("name")).distinct(), F.col("doc_id") == F.col("key"))
        least = names.groupBy("component_id").agg(F.min("name").alias("least"))
        label = names.join(least, "component_id").select(F.col("name").alias("doc_id"), F.col("least").alias("component_id"))
    own = docs.schema["doc_id"].dataType
    return sizes.join(label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").cast(own).alias("component_id"))


def near_duplicates_removed(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component kept, the one with the smallest ``doc_id``; columns unchanged.

    Where ids are no whole numbers, it is the one whose id has the smallest hash. Documents with a null ``doc_id``, or
    without words, are kept.
    """
    other = free_name(docs, "_quire_other")
    others = jaccard_components(docs, k, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(other))
    return docs.join(others, id_key(docs) == others[other], "left_anti")
