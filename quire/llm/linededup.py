"""Line dedup by winnowing: repeated passages are found by guaranteed fingerprints and cut from later places.

A passage often starts in the middle of a physical line, so lines are taken wherever they may begin: every run
of ``LINE`` words is hashed as one line. From each ``WINDOW`` consecutive line hashes the smallest is selected;
a passage of ``LINE + WINDOW - 1`` words that occurs twice has a selected fingerprint in common, and no two
neighbouring fingerprints of it leave a word between them. Places of a fingerprint with the same ``WINDOW - 1`` words
on either side are one class: every passage of that length through a place is found in the first place of its class
(by ``doc_id``). The first places of the classes are joined with the first of them and with the one before. Where a
fingerprint has more than three classes, an earlier class in between may hold more, so each passage of
``LINE + WINDOW - 1`` words through these places is looked up by its own hash. Neighbouring matches at one offset from
one text merge into a run, both ends of a run are extended word by word against that text, and runs of ``min_words``
words or more are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tables import arrow_column, free_name, id_key, mapped, quoted, written
from quire.llm.tokens import Words, mix, pieces, shingles, spans_sum, words

MIN_WORDS = 50
LINE, WINDOW = 26, 25
#: Words by which a run is extended at either end; what lies beyond has a fingerprint of its own.
EXTEND = 50
#: Most runs that are asked of a source at once.
ASKED = 4096


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` consecutive values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def selected(row: np.ndarray, value: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Indexes of values that are the smallest of a window of ``width`` values of one row."""
    if len(value) < width:
        return np.zeros(0, np.int64)
    low = _sliding(value, width, np.minimum)
    low[row[: len(low)] != row[width - 1 :]] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero((_sliding(padded, width, np.maximum) == value) & (value > 0))


def _context(w: Words, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of the words next to a line, ``WINDOW - 1`` on either side or up to the text's ends, from sums over all words."""
    lo, hi = np.maximum(w.first[row], at + 1 - WINDOW), np.minimum(w.first[row + 1], at + LINE + WINDOW - 1)
    before, after = spans_sum(w.hash, lo, at), spans_sum(w.hash, at + LINE, hi)
    return _short(mix(mix(before + (at - lo).astype(np.uint64)) + after + (hi - at).astype(np.uint64)))


def _nearest(group: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier place of each one's group that it does not overlap, or -1; sorted by group and place."""
    spot = (group << 32) + pos
    back = np.searchsorted(spot, spot - LINE, "right") - 1
    return np.where((back >= 0) & (group[back] == group), back, -1) if len(pos) else np.zeros(0, np.int64)


def _reach(hashes: np.ndarray, at: np.ndarray, shift: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, up to ``EXTEND``, are those ``shift`` words before them; ``step`` is the direction."""
    n = np.zeros(len(at), np.int64)
    go = np.arange(len(at))
    for k in range(EXTEND):
        i = at[go] + step * k
        fits = (i - shift[go] >= lo[go]) & (i < hi[go])
        go, i = go[fits], i[fits]
        same = hashes[i] == hashes[i - shift[go]]
        go = go[same]
        if not len(go):
            break
        n[go] += 1
    return n


def _own_runs(w: Words, row: np.ndarray, pos: np.ndarray, own: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the passages that a text has said itself, from its lines at ``pos`` that are also at ``own``."""
    shift = pos - own
    order = np.lexsort((pos, shift, row))
    row, pos, shift = row[order], pos[order], shift[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shift[1:] != shift[:-1]) | (pos[1:] > pos[:-1] + LINE)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row))[: len(head)] - 1
    row, shift = row[head], shift[head]
    lo, hi = w.first[row], w.first[row + 1]
    s, e = lo + pos[head], lo + pos[tail] + LINE
    hashes = _short(w.hash)
    s, e = s - _reach(hashes, s - 1, shift, lo, hi, -1), e + _reach(hashes, e, shift, lo, hi, 1)
    # passages that touch are one: what is cut is their union
    long = np.flatnonzero(e - s >= min_words)
    long = long[np.lexsort((s[long], row[long]))]
    row, s, e = row[long], s[long], np.maximum.accumulate(e[long])
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] > e[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row))[: len(head)] - 1
    lo = w.first[row[head]]
    return row[head], s[head] - lo, e[tail] - lo


def _fingerprints(min_words: int):
    """Texts to the places of their fingerprints (``end`` is -1), and the passages from ``pos`` to ``end`` that they repeat themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for p in pieces(batch.column(2)):
                w = words(p, lower=False)
                row, at, value = shingles(w, LINE, whole=False)
                got = selected(row, value)
                row, value = row[got], value[got]
                pos = at[got] - w.first[row]
                near = _context(w, at[got], row)
                order = np.lexsort((pos, near, value, row))
                r, v, q, c = row[order], value[order], pos[order], near[order]
                new = np.ones(len(order), bool)
                new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1]) | (c[1:] != c[:-1])
                # a fingerprint that a text repeats in the same context is matched here, so that only its first place is dealt by hash
                same = _nearest(np.cumsum(new) - 1, q)
                # the nearest place in any context, so that a period has one offset
                by = np.lexsort((q, v, r))
                start = np.ones(len(by), bool)
                start[1:] = (r[by][1:] != r[by][:-1]) | (v[by][1:] != v[by][:-1])
                any_ = _nearest(np.cumsum(start) - 1, q[by])
                hit, hit_any = np.flatnonzero(same >= 0), np.flatnonzero(any_ >= 0)
                use = np.concatenate([hit, by[hit_any]])
                again = _own_runs(w, r[use], q[use], np.concatenate([q[same[hit]], q[by][any_[hit_any]]]), min_words)
                places = np.flatnonzero(new)
                where = pa.array(np.concatenate([r[places], again[0]]) + p.first)
                # the words' sums deal the passages to all tasks
                fp = np.concatenate([v[places], mix(w.hash[w.first[again[0]] + again[1]] + again[1].astype(np.uint64))])
                none = np.full(len(places), -1, np.int32)
                columns = [np.concatenate([c[places], np.zeros(len(again[0]), np.int32)]), np.concatenate([q[places], again[1]]).astype(np.int32), np.concatenate([none, again[2].astype(np.int32)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(columns[0]), ids.take(where), keys.take(where), pa.array(columns[1]), pa.array(columns[2])],
                    names=["fp", "near", "doc", "key", "pos", "end"],
                )

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the passages through each asked fingerprint that have it as their smallest line."""
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1)
        for p in pieces(batch.column(2)):
            w = words(p, lower=False)
            asked = batch.column(3).slice(p.first, p.rows)
            row = np.repeat(np.arange(p.rows), np.diff(asked.offsets.to_numpy()))
            pos = asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            _, line_at, line = shingles(w, LINE, whole=False)
            _, at, value = shingles(w, LINE + WINDOW - 1, whole=False)
            least = _sliding(line, WINDOW, np.minimum) if len(line) >= WINDOW else line[:0]
            begin = (w.first[row] + pos)[:, None] - np.arange(WINDOW)
            fits = (begin >= w.first[row][:, None]) & (begin + LINE + WINDOW - 1 <= w.first[row + 1][:, None])
            i, back = np.nonzero(fits)
            begin = begin[i, back]
            # a passage's lines are neighbours, so the index of its first line gives its smallest one
            smallest = least[np.searchsorted(line_at, begin)] == line[np.searchsorted(line_at, begin + back)]
            i, begin = i[smallest], begin[smallest]
            where = pa.array(row[i] + p.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[np.searchsorted(at, begin)].view(np.int64)), ids.take(where), keys.take(where), pa.array(pos[i].astype(np.int32))], names=["passage", "doc", "key", "pos"]
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes next to the source of each run: before it (nearest first) and after it."""
    for batch in batches:
        for p in pieces(batch.column(0)):
            w = words(p, lower=False)
            asked = batch.column(1).slice(p.first, p.rows)
            row = np.repeat(np.arange(p.rows), np.diff(asked.offsets.to_numpy()))
            runs = asked.flatten()
            for at in range(0, len(runs), ASKED):
                part, r = runs.slice(at, ASKED), row[at : at + ASKED]
                s, e, shift = (part.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e", "shift"))
                lo, hi = w.first[r], w.first[r + 1]
                before, after = _beside(w, lo + s - shift, lo, -1), _beside(w, lo + e - shift, hi, 1)
                yield pa.RecordBatch.from_arrays([part.field("key"), part.field("s"), part.field("e"), before, after], names=["key", "s", "e", "before", "after"])


def _beside(w: Words, anchor: np.ndarray, end: np.ndarray, sign: int) -> pa.Array:
    size = np.minimum(EXTEND, np.abs(end - anchor))
    offsets = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    index = np.repeat(anchor, size) + (-1 - step if sign < 0 else step)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(_short(w.hash[index])))


def _short(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _alike(hashes: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int, other: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words from ``at`` on are those of ``other`` between each one's ``offsets``; ``step`` is the direction."""
    n, size = np.zeros(len(at), np.int64), np.diff(offsets)
    go = np.arange(len(at))
    for k in range(EXTEND):
        i = at[go] + step * k
        fits = (k < size[go]) & (i >= lo[go]) & (i < hi[go])
        go, i = go[fits], i[fits]
        go = go[hashes[i] == other[offsets[go] + k]]
        if not len(go):
            break
        n[go] += 1
    return n


def _cutter(min_words: int):
    """Text and its runs to the text without them and the number of words removed: extends the runs, cuts the long ones."""

    def run(text: pa.Array, runs: pa.Array) -> pa.Array:
        hit = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
        cut, removed = [None] * len(text), np.zeros(len(text), np.int64)
        if len(hit):
            run_at, x = runs.offsets.to_numpy(), runs.values
            begins, ends = x.field("s").to_numpy(zero_copy_only=False), x.field("e").to_numpy(zero_copy_only=False)
            sides = [(c.offsets.to_numpy().astype(np.int64), c.values.to_numpy(zero_copy_only=False)) for c in (x.field("before"), x.field("after"))]
            for p in pieces(text.take(pa.array(hit))):
                w = words(p, lower=False)
                hashes = _short(w.hash)
                raw = p.data.tobytes()
                docs = hit[p.first : p.first + p.rows]
                count = run_at[docs + 1] - run_at[docs]
                r = np.repeat(np.arange(p.rows), count)
                lo, hi = w.first[r], w.first[r + 1]
                # the runs of a piece's rows are neighbours, as rows without any have none between them
                of = slice(run_at[docs[0]], run_at[docs[-1] + 1])
                s, e = lo + begins[of], lo + ends[of]
                near = [(v, o[of.start : of.stop + 1]) for o, v in sides]
                s, e = s - _alike(hashes, s - 1, lo, hi, -1, *near[0]), e + _alike(hashes, e, lo, hi, 1, *near[1])
                long = e - s >= min_words
                covered = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(covered, s[long], 1)
                np.add.at(covered, e[long], -1)
                covered = np.cumsum(covered) > 0
                for i, r, lo, hi in zip(docs.tolist(), range(p.rows), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    gone = covered[lo:hi]
                    if gone.any():
                        removed[i] = int(gone.sum())
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], ~gone, [False]]).astype(np.int8)))
                        begin = p.offsets[r]
                        kept = []
                        for a, b in zip(edge[::2], edge[1::2], strict=True):
                            x0 = int(begin) if a == 0 else int(w.start[lo + a])
                            x1 = int(p.offsets[r + 1]) if b == hi - lo else int(w.start[lo + b])
                            kept.append(raw[x0:x1])
                        cut[i] = b"".join(kept).decode("utf-8", "replace").rstrip(" \t\n\x0b\x0c\r")
        return pa.StructArray.from_arrays([pa.array(cut, pa.string()), pa.array(removed)], names=["cut", "removed"])

    return run


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "n_removed") -> DataFrame:
    """``docs`` with later repeats of passages of ``min_words`` words or more cut, and column ``removed``, the words cut.

    The first occurrence, by ``doc_id`` (null first; by a hash where it is no whole number), then by position, stays;
    a text may repeat a passage of its own. Words are compared byte for byte, white space is not compared. Other
    columns, with any names and types, come back as they are; ``removed`` must be a new name. Null texts stay null,
    empty ones empty; a copy of an earlier text becomes empty and its row stays. Rows that repeat both ``doc_id`` and
    ``text`` count as one document, so they keep or lose the same words. An empty table gives an empty one.
    ``min_words`` is at least ``LINE + WINDOW - 1``.
    """
    if min_words < LINE + WINDOW - 1:
        raise ValueError(f"passages of fewer than {LINE + WINDOW - 1} words have no guaranteed fingerprint")
    of, spans_of = free_name(docs, "_quire_key"), free_name(docs, "_quire_runs")
    keyed = docs.withColumn(of, F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))
    texts = keyed.select(id_key(docs).alias("doc"), F.col(of).alias("key"), "text").where("text is not null")
    fps = mapped(texts, _fingerprints(min_words), "fp long, near int, doc long, key long, pos int, end int")
    # dealt once, by fingerprint; what is alone with its own leaves before anything else is asked of it
    shared = fps.withColumn("n", F.count("*").over(Window.partitionBy("fp"))).where("n > 1 or end >= 0").drop("n")
    upto = (Window.unboundedPreceding, Window.currentRow)
    of_class = Window.partitionBy("fp", "near").orderBy("doc", "key", "pos").rowsBetween(*upto)
    of_all = Window.partitionBy("fp").orderBy("doc", "key", "pos")
    here = F.struct(F.col("key").alias("src"), F.col("pos").alias("spos"))
    classed = shared.withColumn("first", F.first(here).over(of_class)).withColumn("head", (F.col("end") < 0) & (F.col("first") == here))
    before = F.last(F.when(F.col("head"), here), ignorenulls=True).over(of_all.rowsBetween(Window.unboundedPreceding, -1))
    classes = F.count_if("head").over(Window.partitionBy("fp"))
    earlier = F.when(F.col("head"), F.array(F.first(here).over(of_all.rowsBetween(*upto)), before)).when(F.col("end") < 0, F.array("first"))
    found = classed.select("doc", "key", "pos", "end", earlier.alias("earlier"), (F.col("head") & (classes > 3)).alias("more"))
    # the first place of all has nothing before it
    found = found.withColumn("earlier", F.filter(F.array_distinct("earlier"), lambda x: x.isNotNull() & ~((x["src"] == F.col("key")) & (x["spos"] == F.col("pos")))))
    found = written(found.where("more or size(earlier) > 0 or end >= 0"))
    wanted = found.where("more").groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("asked"))
    passages = mapped(texts.join(wanted, "key").select("doc", "key", "text", "asked"), _passages, "passage long, doc long, key long, pos int")
    top = F.first(here).over(Window.partitionBy("passage").orderBy("doc", "key", "pos").rowsBetween(*upto))
    rest = passages.select("key", "pos", top.alias("x")).select("key", "pos", "x.*").where("key <> src or pos <> spos").distinct()
    hits = found.select("key", "pos", F.explode("earlier").alias("x")).select("key", "pos", "x.*").unionByName(rest)
    # in one text, places that overlap are no repeat; dealt once, by the text
    hits = hits.where(f"key <> src or pos - spos >= {LINE}").repartition("key").select("key", "src", (F.col("pos") - F.col("spos")).alias("shift"), "pos")
    order = Window.partitionBy("key", "src", "shift").orderBy("pos")
    islands = hits.withColumn("new", F.coalesce(F.col("pos") > F.lag("pos").over(order) + LINE, F.lit(True))).withColumn("island", F.sum(F.col("new").cast("int")).over(order.rowsBetween(*upto)))
    runs = written(islands.groupBy("key", "src", "shift", "island").agg(F.min("pos").alias("s"), (F.max("pos") + LINE).alias("e")).drop("island"))
    # a text is asked for at most ASKED runs at once, however many texts say what it said first
    asked = runs.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("src").orderBy("key", "shift", "s")) - 1) / ASKED))
    asked = asked.groupBy("src", "part").agg(F.collect_list(F.struct("key", "s", "e", "shift")).alias("asked")).withColumnRenamed("src", "key")
    sources = texts.select("key", "text").join(asked, "key").dropDuplicates(["key", "part"]).select("text", "asked")
    spans = mapped(sources, _contexts, "key long, s int, e int, before array<int>, after array<int>")
    none = F.array().cast("array<int>")
    own = found.where("end >= 0").select("key", F.col("pos").alias("s"), F.col("end").alias("e"), none.alias("before"), none.alias("after"))
    per_doc = spans.unionByName(own).groupBy(F.col("key").alias(of)).agg(F.collect_list(F.struct("s", "e", "before", "after")).alias(spans_of))
    cut = arrow_column(docs.sparkSession, _cutter(min_words), "cut string, removed long", F.when(F.col(spans_of).isNotNull(), F.col("text")), F.col(spans_of))
    done = free_name(docs, "_quire_cut")
    joined = keyed.join(per_doc, of, "left").withColumn(done, cut)
    text = F.when(F.col(done)["removed"] > 0, F.col(done)["cut"]).otherwise(F.col("text"))
    kept = [text.alias(c) if c == "text" else x for c, x in zip(docs.columns, quoted(docs), strict=True)]
    return joined.select(*kept, F.col(done)["removed"].alias(removed))


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``text`` after the cuts, ``n_removed`` words. See ``dedup_passages``."""
    return dedup_passages(docs.select("doc_id", "text"))


def lines_deduped(docs: DataFrame) -> DataFrame:
    """``docs`` with the cuts made, a row each; ``n_chars``, where there is one, follows the new text."""
    removed = free_name(docs, "_quire_removed")
    out = dedup_passages(docs, removed=removed)
    columns = quoted(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        at = docs.columns.index("n_chars")
        columns[at] = F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*columns)
