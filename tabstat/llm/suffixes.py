"""Suffix-array dedup over bytes, with deep-shallow sorting.

A corpus-wide suffix array would have an entry per byte. Only suffixes that can
share their first ``length`` bytes with another matter, so each window of that
length is first keyed by its canonical anchor (the least hashed ``ANCHOR``-byte run
in it, which equal windows hold at the same place), and windows whose anchor is
unique in the corpus are out. The others, with their bytes, meet at the reducer of
their anchor and are sorted, in buckets of one anchor at one place: multikey
quicksort, symbol by symbol (8 bytes each), to SHALLOW bytes, then a blind trie for
every group that still shares its prefix. In the sorted order, neighbours with a
common prefix of ``length`` bytes are equal windows. Of stretches that are equal as a
whole only one is sorted, for all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabstat.llm import anchors as A
from tabstat.llm import kernel as K
from tabstat.llm import spread as S
from tabstat.llm.anchors import string_array

LENGTH = 50
ANCHOR = 16
#: Depth in bytes at which quicksort hands over to blind tries.
SHALLOW = 32
#: Text that a task gathers before it sends it on, in bytes.
FLUSH_BYTES = 8 << 20
#: Tails that are cut out of the text at once.
TAILS = 1 << 16


class BlindTrie:
    """Sorted set of equally long strings; inner nodes hold only the depth at which children differ."""

    def __init__(self):
        self.root = None
        self.size = 0

    def add(self, s: bytes) -> int:
        """The string's number, in order of first insertion."""
        if self.root is None:
            self.root, self.size = (s, 0), 1
            return 0
        node = self.root
        while type(node) is list:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other, number = node
        if other == s:
            return number
        depth = 0
        while s[depth] == other[depth]:
            depth += 1
        above, node = None, self.root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        leaf = (s, self.size)
        self.size += 1
        if type(node) is list and node[0] == depth:
            node[1][s[depth]] = leaf
            return leaf[1]
        inner = [depth, {other[depth]: node, s[depth]: leaf}]
        if above is None:
            self.root = inner
        else:
            above[1][s[above[0]]] = inner
        return leaf[1]

    def order(self) -> list[int]:
        """Numbers of the strings in byte order."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if type(node) is list:
                below = node[1]
                todo += [below[b] for b in sorted(below, reverse=True)]
            else:
                out.append(node[1])
        return out


def _symbols(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one big-endian number."""
    out = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for n in (1, 2, 4):
        out = (out[:-n] << np.uint64(8 * n)) | out[n:]
    return out[: len(data)]


def multikey_quicksort(symbols: np.ndarray, start: np.ndarray, depth: int, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at start by bucket and their first depth bytes, and the first place of each one's group of equals.

    Three-way partition by a pivot symbol. The groups of one round are partitioned
    side by side: what is below the pivot and what is above it is partitioned again
    by the same symbol, what equals it goes a symbol deeper.
    """
    order, group, deep = np.arange(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    if bucket is not None and len(start):
        order = np.argsort(bucket, kind="stable")
        first = K.runs(bucket[order])
        group = np.repeat(first, np.diff(np.append(first, len(start))))
    live = np.arange(len(start))
    while len(live):
        g, d = group[live], deep[live]
        first = K.runs(g)
        size = np.diff(np.append(first, len(live)))
        many = np.repeat((size > 1) & (d[first] < depth), size)
        if not many.all():
            live, g, d = live[many], g[many], d[many]
            first = K.runs(g)
            size = np.diff(np.append(first, len(live)))
            if not len(live):
                break
        key = symbols[start[order[live]] + d]
        # The pivot is the median of the group's first, middle and last symbol.
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        below, equal = key < pivot, key == pivot
        lead = np.repeat(first, size)
        count = lambda mark: np.cumsum(mark) - np.repeat(np.cumsum(mark)[first] - mark[first], size)
        n_below, n_equal = (np.repeat(np.add.reduceat(x.astype(np.int64), first), size) for x in (below, equal))
        up_below, up_equal = count(below), count(equal)
        nth = np.arange(len(live)) - lead + 1
        place = lead + np.where(below, up_below, np.where(equal, n_below + up_equal, n_below + n_equal + nth - up_below - up_equal)) - 1
        moved = np.empty(len(live), np.int64)
        moved[place] = order[live]
        order[live] = moved
        head = g + np.where(below, 0, np.where(equal, n_below, n_below + n_equal))
        group[live[place]], deep[live[place]] = head, d + 8 * equal
    return order, group


def deep_shallow(data: np.ndarray, start: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW, bucket: np.ndarray | None = None) -> np.ndarray:
    """Order of the suffixes of data at start by their first length bytes, in each bucket."""
    symbols = _symbols(data)
    order, group = multikey_quicksort(symbols, start, shallow, bucket)
    # Deep: groups share `shallow` bytes. One that is all equal is a trie of one leaf.
    first = K.runs(group)
    edge = np.append(first, len(group))
    lead = np.repeat(first, np.diff(edge))
    differs = np.zeros(len(order), bool)
    for d in (*range(shallow, length - 8, 8), length - 8):
        key = symbols[start[order] + d]
        differs |= key != key[lead]
    uneven = np.logical_or.reduceat(differs, first) if len(first) else differs
    at = np.flatnonzero(np.repeat(uneven, np.diff(edge)))
    width = length - shallow
    rank: list[int] = []
    for low in range(0, len(at), TAILS):
        tails = data[(start[order[at[low : low + TAILS]]] + shallow)[:, None] + np.arange(width)].tobytes()
        rank += [tails[i : i + width] for i in range(0, len(tails), width)]
    done = 0
    for n in np.diff(edge)[uneven].tolist():
        trie = BlindTrie()
        numbers = [trie.add(s) for s in rank[done : done + n]]
        place = [0] * trie.size
        for i, k in enumerate(trie.order()):
            place[k] = i
        rank[done : done + n] = [place[k] for k in numbers]
        done += n
    order[at] = order[at][np.lexsort((rank, group[at]))] if len(at) else order[at]
    return order


def shares(data: np.ndarray, start: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in order has a common prefix of length bytes or more with the one before it."""
    symbols, out = _symbols(data), np.zeros(len(order), bool)
    out[1:] = True
    for d in (*range(0, length - 8, 8), length - 8):
        key = symbols[start[order] + d]
        out[1:] &= key[1:] == key[:-1]
    return out


def repeats(rows: DataFrame, log_p: int, length: int, anchor: int, **how) -> DataFrame:
    """SPANS, in bytes, of the windows that a smaller id has too."""

    def canonical(data, offsets):
        room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
        grams = K.window_hashes(data.astype(np.uint64) + np.uint64(1), anchor)
        return grams, *A.canonical(room, grams, length, anchor)

    def anchors_of(data, offsets):
        grams, _, place = canonical(data, offsets)
        place = place[K.runs(place)]
        return grams[place], np.searchsorted(offsets, place, "right") - 1

    def collect(ids, data, offsets, known):
        grams, starts, place = canonical(data, offsets)
        mine = known.repeated(grams[place])
        starts, place = starts[mine], place[mine]
        if not len(starts):
            return None
        a, n, place = A.stretches(starts, place, known.often(grams[place]))
        often = known.often(grams[place])
        b = a + n + length - 1
        row = np.searchsorted(offsets, a, "right") - 1
        values = data.astype(np.uint64) + np.uint64(1)
        sums = [K.prefix_sums(values, w) for w in (0, 1)]
        same = [K.span_hashes(c, a, b, w) for w, c in enumerate(sums)]
        home = np.where(often, K.span_hashes(sums[0], a, a + length), grams[place])
        return (home, place - a, n, ids[row], S.text_keys(data, offsets)[row], (a - offsets[row]).astype(np.int32), *same), K.gather(data, a, b - a), b - a

    def close(held):
        return A.pack([np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), log_p, False)

    def visit(batches, known):
        return A.gathered(batches, lambda *slice_: collect(*slice_, known), FLUSH_BYTES, close)

    def settle(table: pa.Table) -> pa.Table:
        settled, off, n = S.unpack(table, "kind", np.uint8) > 0, S.unpack(table, "off", np.uint8).astype(np.int64), S.unpack(table, "n", np.uint8).astype(np.int64)
        doc, key, pos = S.unpack(table, "id", np.int64), S.unpack(table, "text_key", np.uint64), S.unpack(table, "pos", np.int32).astype(np.int64)
        data = S.unpack(table, "context", np.uint8)
        here = np.flatnonzero(~settled)
        size = n[here] + length - 1
        at = np.cumsum(size) - size
        lead = A.distinct_stretches(data, at, size)
        # Every stretch has its windows; those of the first of equal stretches are sorted.
        item = np.repeat(np.arange(len(here)), n[here])
        inside = np.arange(len(item)) - np.repeat(np.cumsum(n[here]) - n[here], n[here])
        base = np.cumsum(n[here]) - n[here]
        sorted_ = np.flatnonzero((lead == np.arange(len(here)))[item])
        start = (at[item] + inside)[sorted_]
        seed = np.repeat(at + off[here], n[here])[sorted_]
        grams = K.window_hashes(data.astype(np.uint64) + np.uint64(1), anchor)
        order = deep_shallow(data, start, length, bucket=grams[seed] + (seed - start).astype(np.uint64))
        equal = np.empty(len(item), np.int64)
        equal[sorted_[order]] = np.cumsum(~shares(data, start, order, length))
        equal = equal[base[lead[item]] + inside]
        least = np.full(int(equal.max()) + 1 if len(equal) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, equal, doc[here[item]])
        late = np.flatnonzero(doc[here[item]] > least[equal])
        return A.flag(here[item[late]], inside[late], n, doc, key, pos, settled, length, log_p)

    found = A.visit(rows, anchors_of, visit, A.STRETCHES, log_p, **how)
    return found.groupBy("part").applyInArrow(S.lean_group(settle), A.SPANS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, anchor: int = ANCHOR, **how) -> DataFrame:
    """Cuts every byte inside a ``length``-byte string that also starts in a document with a smaller id.

    Texts are UTF-8 bytes and matches stay inside one document. Returns one row
    per input row: ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept`` (remaining bytes, binary: a cut may fall inside a
    character).

    Null text is empty. A null id sorts last. Rows that share an id are one
    document: neither loses bytes to the other. Texts of any length are read whole,
    a slice at a time. Other columns are not read. ``bitmap_input`` and ``often`` are
    those of anchors.visit.
    """
    if not SHALLOW + 8 <= length <= 255 or not 8 <= anchor <= length:
        raise ValueError("length must be 40 to 255 bytes, and anchor 8 to length")
    S.tune(docs.sparkSession)
    rows = S.texts(docs, id_col, text_col)
    # Sorting takes some 300 bytes for each byte of repeated text, so reducers get half of the usual share.
    log_p = S.log_parts(rows) + 1
    flags = repeats(rows, log_p, length, anchor, **how)

    def cut(table: pa.Table, flagged: pa.Table) -> pa.Table:
        spans, columns = A.Spans(flagged), [[np.empty(0, np.int64)] for _ in range(3)]
        names, kept, ids_out = ["n_bytes", "n_removed", "n_spans"], [], []
        for batch in table.to_batches():
            ids = S.ids_of(batch)
            for low, high, data, offsets in K.text_slices(batch.column(batch.schema.get_field_index("text"))):
                gone = spans.cover(ids[low:high], data, offsets, offsets, len(data))
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                edges = offsets[:-1][np.diff(offsets) > 0]
                opens[edges] = gone[edges]
                at = np.concatenate(([0], np.cumsum(~gone)))[offsets]
                columns[0].append(np.diff(offsets))
                columns[1].append(np.diff(offsets) - np.diff(at))
                columns[2].append(np.diff(np.concatenate(([0], np.cumsum(opens)))[offsets]))
                kept.append(string_array(data[~gone], at, pa.binary()))
            ids_out.append(batch.column(batch.schema.get_field_index("id")))
        out = {"id": pa.chunked_array(ids_out, pa.int64()), **{c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in zip(names, columns, strict=True)}, "kept": pa.chunked_array(kept, pa.binary())}
        return pa.table(out)

    return A.with_part(rows, log_p).groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(S.lean_cogroup(cut), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
