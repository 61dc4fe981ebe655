"""What substring and suffix dedup share: anchors that repeat in a corpus, and spans that are cut from texts.

A window's canonical anchor is the least hashed run of a few symbols in it: equal
windows hold it at the same place. A window whose anchor occurs once in the corpus
has no copy. Neighbouring windows with one canonical anchor are a stretch: the
anchor, and as much text on both sides as these windows reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm import kernel as K
from tabstat.llm import spread as S

#: Inputs up to so many bytes broadcast a bitmap of the repeated anchors, which they fill to a fraction; larger ones ask by parts.
BITMAP_INPUT = 8 << 30
#: Anchors met so often are dealt out window by window: what lies around them doesn't meet in one task.
OFTEN = 20_000

SPANS = "part int, id binary, text_key binary, pos binary, length binary"


class Known:
    """Anchors that occur more than once (repeated may let others through too), and those that occur often."""

    def __init__(self, repeated: Callable, often: Callable):
        self.repeated, self.often = repeated, often


def canonical(room: np.ndarray, grams: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all whole windows, and the place of each one's canonical anchor. room: symbols to the text's end."""
    starts = np.flatnonzero(room >= window)
    if not len(starts):
        return starts, starts
    place = np.uint64(0xFFFFFFFF)
    least = K.sliding((grams & ~place) | np.arange(len(grams), dtype=np.uint64), window - anchor + 1, np.minimum)
    return starts, (least[starts] & place).astype(np.int64)


def stretches(starts: np.ndarray, place: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each stretch; windows marked by split are stretches of their own."""
    first = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 0) | (np.diff(starts) != 1) | split[1:]))) if len(starts) else starts
    return starts[first], np.diff(np.append(first, len(starts))), place[first]


def visit(rows: DataFrame, anchors_of: Callable, extend: Callable, schema: str, log_p: int, *, bitmap_input: int = BITMAP_INPUT, often: int = OFTEN) -> DataFrame:
    """extend(batches, known) over all rows (id, text).

    anchors_of(data, offsets) gives the hash and the text of each canonical anchor
    of a slice. Up to bitmap_input bytes the repeated anchors are broadcast as a
    bitmap. Beyond, every text's part asks the anchors' parts, by joins that Spark
    splits where an anchor is common, and the answers meet the text at its part: no
    table is broadcast but the names of anchors met `often`, whose number is the
    corpus's anchors over `often` at most.
    """
    spark, rows = rows.sparkSession, rows.select("id", "text")
    if S.size_bytes(rows) <= bitmap_input:
        log_b = S.bitmap_parts(log_p)

        def scan(batches):
            for batch in batches:
                found = S.HashSet(log_b)
                for _, _, data, offsets in K.text_slices(batch.column(1)):
                    found.add(anchors_of(data, offsets)[0])
                yield from found.flush()

        known = spark.sparkContext.broadcast(S.bitmap(rows.mapInArrow(S.lean(scan), S.HASHES), log_b, 2, often))

        def with_bitmap(batches):
            bits, names = known.value
            yield from extend(batches, Known(lambda h: S.in_bitmap(bits, h, log_b), lambda h: S.is_in(S.short_name(h, log_b), names)))

        return rows.mapInArrow(S.lean(with_bitmap), schema)

    def ask(batches):
        for batch in batches:
            ids = S.ids_of(batch)
            for low, high, data, offsets in K.text_slices(batch.column(1)):
                h, row = anchors_of(data, offsets)
                part = S.row_part(ids[low:high], S.text_keys(data, offsets), log_p)[row]
                order = np.lexsort((h, part))
                h, part = h[order], part[order]
                first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])))) if len(h) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[first].view(np.int64)), "part": pa.array(part[first]), "n": pa.array(np.diff(np.append(first, len(h))))})

    asks = rows.mapInArrow(S.lean(ask), "h bigint, part int, n bigint")
    many = S.write_table(asks.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    names = np.sort(np.array([r.h for r in many.where(F.col("n") >= often).select("h").collect()], np.int64).view(np.uint64))
    common = spark.sparkContext.broadcast(names)
    answers = asks.select("h", "part").join(many.select("h"), "h")

    def with_answers(table: pa.Table, found: pa.Table) -> pa.Table:
        own = np.unique(found.column("h").to_numpy().view(np.uint64)) if found.num_rows else np.empty(0, np.uint64)
        out = list(extend(table.select(["id", "text"]).to_batches(), Known(lambda h: S.is_in(h, own), lambda h: S.is_in(h, common.value)))) if found.num_rows else []
        return pa.Table.from_batches(out) if out else pa.table({c: pa.array([], pa.int32() if c == "part" else pa.binary()) for c in (x.split()[0] for x in schema.split(", "))})

    return with_part(rows, log_p).groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(S.lean_cogroup(with_answers), schema)


def with_part(rows: DataFrame, log_p: int) -> DataFrame:
    """rows with their part, where their spans are."""

    def add(batches):
        for batch in batches:
            ids, part = S.ids_of(batch), [np.empty(0, np.int32)]
            for low, high, data, offsets in K.text_slices(batch.column(1)):
                part.append(S.row_part(ids[low:high], S.text_keys(data, offsets), log_p))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), *batch.columns], ["part", *batch.schema.names])

    return rows.mapInArrow(S.lean(add), "part int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def pack(held: list[tuple], text: np.ndarray, width: np.ndarray, log_p: int, same_document: bool) -> pa.RecordBatch:
    """Stretches on their way: to the part of their anchor, or of their window if it is dealt out alone.

    held: by stretch (part hash, anchor's offset, windows, id, text key, position, two
    content hashes). A stretch that is here whole and earlier too is settled: it goes to
    its document's part without its text. Hashes propose such a pair, bytes decide.
    same_document: earlier in the same document counts.
    """
    h, off, n, doc, key, pos, s0, s1 = held
    at = np.cumsum(width) - width
    # Stretches around one anchor are alike: side by side, they compress to little.
    order = np.lexsort((pos, doc, off, s1, s0))
    same = lambda x: x[order][1:] == x[order][:-1]
    new = np.concatenate(([True], ~(same(s0) & same(s1) & same(off) & same(n) & same(width))))
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    settled = doc > doc[lead]
    if same_document:
        settled |= (doc == doc[lead]) & (pos > pos[lead])
    late = np.flatnonzero(settled)
    if len(late):
        differs = K.gather(text, at[late], width[late]) != K.gather(text, at[lead[late]], width[late])
        settled[late[np.add.reduceat(differs, np.cumsum(width[late]) - width[late]) > 0]] = False
    part = np.where(settled, S.row_part(doc, key, log_p), S.part_of(S.spread_out(h), log_p))
    by = np.lexsort((s0, h, part))
    part, settled, width, at = part[by], settled[by], np.where(settled, 0, width)[by], at[by]
    out = S.route(part, {"kind": settled.astype(np.uint8), "off": off[by].astype(np.uint8), "n": n[by].astype(np.uint8), "id": doc[by], "text_key": key[by], "pos": pos[by]})
    ends = np.concatenate(([0], np.cumsum(width)))
    context = string_array(K.gather(text, at, width), ends[np.append(K.runs(part), len(part))], pa.binary())
    return pa.RecordBatch.from_arrays([*out.columns, context], [*out.schema.names, "context"])


STRETCHES = "part int, kind binary, off binary, n binary, id binary, text_key binary, pos binary, context binary"


def flag(item: np.ndarray, inside: np.ndarray, n: np.ndarray, doc: np.ndarray, key: np.ndarray, pos: np.ndarray, settled: np.ndarray, window: int, log_p: int) -> pa.Table:
    """SPANS of the marked windows (stretch, window in it; sorted) and of whole settled stretches."""
    first = np.flatnonzero(np.concatenate(([True], (np.diff(item) != 0) | (np.diff(inside) != 1)))) if len(item) else np.empty(0, np.int64)
    run = np.diff(np.append(first, len(item)))
    owner = np.concatenate((item[first], np.flatnonzero(settled)))
    at = np.concatenate((pos[item[first]] + inside[first], pos[settled]))
    span = np.concatenate((run, n[settled])) + window - 1
    order = np.lexsort((at, key[owner]))
    owner, at, span = owner[order], at[order].astype(np.int32), span[order].astype(np.int32)
    return pa.Table.from_batches([S.route(S.row_part(doc[owner], key[owner], log_p), {"id": doc[owner], "text_key": key[owner], "pos": at, "length": span})])


def distinct_stretches(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each span of data the first one with the same bytes: hashes propose, bytes decide."""
    h = K.span_hashes(K.prefix_sums(data.astype(np.uint64) + np.uint64(1)), at, at + size)
    order = np.lexsort((size, h))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1]))) if len(order) else np.empty(0, bool)
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    other = np.flatnonzero(lead != np.arange(len(lead)))
    if len(other):
        differs = K.gather(data, at[other], size[other]) != K.gather(data, at[lead[other]], size[other])
        odd = other[np.add.reduceat(differs, np.cumsum(size[other]) - size[other]) > 0]
        lead[odd] = odd
    return lead


class Spans:
    """Spans of a part by (id, text key)."""

    def __init__(self, table: pa.Table):
        doc, key = S.unpack(table, "id", np.int64), S.unpack(table, "text_key", np.uint64)
        pos, length = S.unpack(table, "pos", np.int32).astype(np.int64), S.unpack(table, "length", np.int32).astype(np.int64)
        order = np.lexsort((pos, doc, key))
        doc, key, self.pos, self.length = doc[order], key[order], pos[order], length[order]
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(doc) else np.empty(0, np.int64)
        self.where = dict(zip(zip(doc[first].tolist(), key[first].tolist(), strict=True), zip(first.tolist(), np.append(first, len(doc))[1:].tolist(), strict=True), strict=True))

    def cover(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        """Marks of the n symbols of a slice that lie in spans; first: each text's first symbol. Spans that touch make one passage."""
        edge = np.zeros(n + 1, np.int64)
        for r, pair in enumerate(zip(ids.tolist(), S.text_keys(data, offsets).tolist(), strict=True)) if self.where else ():
            if pair in self.where:
                a, b = self.where[pair]
                np.add.at(edge, first[r] + self.pos[a:b], 1)
                np.add.at(edge, first[r] + self.pos[a:b] + self.length[a:b], -1)
        return np.cumsum(edge[:-1]) > 0


def string_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.Array.from_buffers(kind or pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def gathered(batches: Iterator[pa.RecordBatch], collect: Callable, flush_bytes: int, close: Callable) -> Iterator[pa.RecordBatch]:
    """Closes what collect(ids, data, offsets) returns (columns, text, widths; or None) every flush_bytes of text and at the end."""
    held, waiting = [], 0
    for batch in batches:
        ids = S.ids_of(batch)
        for low, high, data, offsets in K.text_slices(batch.column(batch.schema.get_field_index("text"))):
            found = collect(ids[low:high], data, offsets)
            if found is not None:
                held.append(found)
                waiting += len(found[1])
            if held and waiting > flush_bytes:
                yield close(held)
                held, waiting = [], 0
    if held:
        yield close(held)
