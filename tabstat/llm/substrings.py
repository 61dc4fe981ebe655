"""Substring dedup: seed and extend over word sequences.

Every run of ``window`` words holds one canonical anchor: the winnowed (least
hashed) run of ``anchor`` words in it, which any equal run holds at the same
place. Anchors that occur once can't seed a match; documents meet at the others,
each with the words around its occurrence (its stretch). There matches are extended
word by word, to the left and to the right. An occurrence that nothing agrees with
any more drops out; where left and right extension together reach ``window``
words, all but the earliest occurrence are repeats. Repeats that touch or overlap
in a document make its maximal repeated passages, which are cut.

Matches are extended by classes of occurrences that agree so far instead of by
pairs: equality is transitive, so thousands of copies cost their length. Words are
compared as codes that stand for their very bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm import anchors as A
from tabstat.llm import kernel as K
from tabstat.llm import spread as S
from tabstat.llm.anchors import string_array

WINDOW = 20
ANCHOR = 8
#: Text that a task gathers before it sends it on, in bytes.
FLUSH_BYTES = 8 << 20


def word_codes(words: K.Words) -> np.ndarray:
    """A number for each word, the same for equal words only: hashes propose, bytes decide."""
    h = words.hashes()
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    size = words.end - words.start
    lead = first[code]
    odd = size != size[lead]
    alike = np.flatnonzero(~odd & (lead != np.arange(len(h))))
    if len(alike):
        differs = K.gather(words.data, words.start[alike], size[alike]) != K.gather(words.data, words.start[lead[alike]], size[alike])
        odd[alike[np.add.reduceat(differs, np.cumsum(size[alike]) - size[alike]) > 0]] = True
    names: dict[bytes, int] = {}
    for i in np.flatnonzero(odd).tolist():
        code[i] = len(first) + names.setdefault(words.data[words.start[i] : words.end[i]].tobytes(), len(names))
    return code


def refine(group: np.ndarray, code: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Groups of items that agree in group and code; -1 for items alone (without copies), and where either is -1."""
    out = np.full(len(group), -1, np.int64)
    at = np.flatnonzero((group >= 0) & (code >= 0))
    if len(at):
        _, own = np.unique(group[at] * (int(code.max()) + 1) + code[at], return_inverse=True)
        out[at] = np.where(np.bincount(own, copies[at])[own] > 1, own, -1)
    return out


def extend(code: np.ndarray, first: np.ndarray, off: np.ndarray, n: np.ndarray, alike: np.ndarray, doc: np.ndarray, pos: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence, window in it) of all windows that start earlier too.

    Stretch i has the codes from first[i] on, n[i] windows, and its anchor off[i]
    words from its start. Occurrence j of stretch alike[j] is at place pos[j] of
    document doc[j].
    """
    size, copies = n + window - 1, np.bincount(alike, minlength=len(n))

    def word(at):
        inside = (at >= 0) & (at < size)
        return np.where(inside, code[np.minimum(first + np.where(inside, at, 0), len(code) - 1)], -1) if len(code) else at

    seed = np.zeros(len(first), np.int64)
    for k in range(anchor):
        seed = refine(seed, word(off + k), copies)
    right = [seed]
    for k in range(window - anchor):
        right.append(refine(right[-1], word(off + anchor + k), copies))
    # Windows at one distance from their anchors have the order of the anchors.
    by_place = np.lexsort((pos + off[alike], doc))
    items, insides, left = [np.empty(0, np.int64)], [np.empty(0, np.int64)], seed
    for k in range(window - anchor + 1):
        if k:
            left = refine(left, word(off - k), copies)
        inside = off - k
        whole = refine(np.where((inside >= 0) & (inside < n), left, -1), right[window - anchor - k], copies)
        at = by_place[whole[alike[by_place]] >= 0]
        at = at[np.argsort(whole[alike[at]], kind="stable")]
        g, d, p = whole[alike[at]], doc[at], pos[at] + inside[alike[at]]
        lead = K.runs(g)
        lead = np.repeat(lead, np.diff(np.append(lead, len(g))))
        late = at[(d != d[lead]) | (p != p[lead])]
        items.append(late)
        insides.append(inside[alike[late]])
    item, inside = np.concatenate(items), np.concatenate(insides)
    order = np.lexsort((inside, item))
    return item[order], inside[order]


def repeats(rows: DataFrame, log_p: int, window: int, anchor: int, **how) -> DataFrame:
    """SPANS, in words, of the windows that start earlier too."""

    def canonical(data, offsets):
        words = K.Words(data, offsets, K.BLANK_WORDS)
        h = words.hashes()
        grams = K.window_hashes(h, anchor)
        return words, h, grams, *A.canonical(words.room(), grams, window, anchor)

    def anchors_of(data, offsets):
        words, _, grams, _, place = canonical(data, offsets)
        place = np.unique(place)
        return grams[place], words.text_of_word()[place]

    def collect(ids, data, offsets, known):
        words, h, grams, starts, place = canonical(data, offsets)
        mine = known.repeated(grams[place])
        starts, place = starts[mine], place[mine]
        if not len(starts):
            return None
        often = known.often(grams[place])
        a, n, place = A.stretches(starts, place, often)
        often = known.often(grams[place])
        b = a + n + window - 1
        row = words.text_of_word()[a]
        # Words joined by one space, and a line feed after each stretch.
        ends = np.cumsum(words.end - words.start + 1)
        begins = ends - (words.end - words.start + 1)
        plain = np.full(ends[-1], 0x20, np.uint8)
        letter = np.ones(len(plain), bool)
        letter[ends - 1] = False
        plain[letter] = data[K.BLANK_WORDS[data]]
        width = ends[b - 1] - begins[a]
        text = K.gather(plain, begins[a], width)
        text[np.cumsum(width) - 1] = 0x0A
        sums = [K.prefix_sums(words.hashes(w) if w else h, w) for w in (0, 1)]
        same = [K.span_hashes(c, a, b, w) for w, c in enumerate(sums)]
        home = np.where(often, K.span_hashes(sums[0], a, np.minimum(a + window, b)), grams[place])
        return (home, place - a, n, ids[row], S.text_keys(data, offsets)[row], (a - words.first[row]).astype(np.int32), *same), text, width

    def close(held):
        return A.pack([np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), log_p, True)

    def visit(batches, known):
        return A.gathered(batches, lambda *slice_: collect(*slice_, known), FLUSH_BYTES, close)

    def settle(table: pa.Table) -> pa.Table:
        settled, off, n = S.unpack(table, "kind", np.uint8) > 0, S.unpack(table, "off", np.uint8).astype(np.int64), S.unpack(table, "n", np.uint8).astype(np.int64)
        doc, key, pos = S.unpack(table, "id", np.int64), S.unpack(table, "text_key", np.uint64), S.unpack(table, "pos", np.int32).astype(np.int64)
        data = S.unpack(table, "context", np.uint8)
        here = np.flatnonzero(~settled)
        code = word_codes(K.Words(data, np.array([0, len(data)]), K.BLANK_WORDS))
        size = n[here] + window - 1
        # Stretches end with a line feed. Equal ones are extended once.
        ends = np.flatnonzero(data == 0x0A) + 1
        lead = A.distinct_stretches(data, np.concatenate((ends[:0], [0], ends[:-1]))[: len(ends)], np.diff(np.concatenate(([0], ends))))
        one, alike = np.unique(lead, return_inverse=True)
        item, inside = extend(code, (np.cumsum(size) - size)[one], off[here][one], n[here][one], alike, doc[here], pos[here], window, anchor)
        return A.flag(here[item], inside, n, doc, key, pos, settled, window, log_p)

    found = A.visit(rows, anchors_of, visit, A.STRETCHES, log_p, **how)
    return found.groupBy("part").applyInArrow(S.lean_group(settle), A.SPANS)


def join_words(words: K.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the kept words of each text, joined by one space."""
    row = words.text_of_word()[keep]
    start, length = words.start[keep], (words.end - words.start)[keep]
    last = np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.empty(0, bool)
    width = length + ~last
    at = np.concatenate(([0], np.cumsum(width)))
    out = np.full(at[-1], 0x20, np.uint8)
    source = np.arange(length.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(length)))[:-1], length)
    target = np.arange(length.sum()) + np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(length)))[:-1], length)
    out[target] = words.data[source]
    return out, at[np.searchsorted(row, np.arange(len(words.counts) + 1))]


def _cut_words(words: K.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each text without its removed words and the white space after them."""
    n = len(words.data)
    row = words.text_of_word()
    after = np.append(words.start, n)[1:] if len(words.start) else words.start
    after = np.minimum(after, words.offsets[1:][row])
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, words.start[~keep], 1)
    np.add.at(edge, after[~keep], -1)
    stay = np.cumsum(edge[:-1]) == 0
    return words.data[stay], np.concatenate(([0], np.cumsum(stay)))[words.offsets]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, anchor: int = ANCHOR, carry: list[str] | None = None, layout: str = "words", **how) -> DataFrame:
    """Cuts every word inside a ``window``-word run that also starts earlier in the corpus.

    Earlier means a smaller id, or the same id and an earlier start. Returns one
    row per input row: ``id``, ``n_words``, ``n_removed``, ``kept`` and the
    carried columns as c0, c1, ... ``kept`` is the kept words joined by one space
    (layout "words") or the text without the cut words and the white space after
    them (layout "text").

    Null text: no words; ``kept`` is empty, or null in layout "text". A null id
    sorts last. Rows equal in id and text are one document met several times and
    get equal results; rows that share an id but not the text are compared by
    start. Texts of any length are read whole, a slice at a time. Other columns can
    have any name, as only the id, the text and the carried ones are read.
    ``bitmap_input`` and ``often`` are those of anchors.visit.
    """
    if layout not in ("words", "text") or not 0 < anchor <= window <= 200:
        raise ValueError("layout must be words or text, and 0 < anchor <= window <= 200")
    spark = docs.sparkSession
    S.tune(spark)
    inside = K.BLANK_WORDS
    rows = S.texts(docs, id_col, text_col, carry)
    log_p = S.log_parts(rows)
    flags = repeats(rows, log_p, window, anchor, **how)
    carried = [f for f in rows.schema if f.name not in ("id", "text")]

    def cut(table: pa.Table, flagged: pa.Table) -> pa.Table:
        spans, done = A.Spans(flagged), []
        for batch in table.to_batches():
            ids, text = S.ids_of(batch), batch.column(batch.schema.get_field_index("text"))
            for low, high, data, offsets in K.text_slices(text):
                words = K.Words(data, offsets, inside)
                gone = spans.cover(ids[low:high], data, offsets, words.first, len(words.start))
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
                kept = string_array(*(join_words if layout == "words" else _cut_words)(words, ~gone))
                part = batch.slice(low, high - low)
                if layout == "text":
                    kept = pc.if_else(pc.is_null(part.column(part.schema.get_field_index("text"))), pa.scalar(None, pa.string()), kept)
                done.append(pa.Table.from_arrays([part.column(part.schema.get_field_index("id")), pa.array(words.counts), pa.array(removed), kept, *(part.column(part.schema.get_field_index(f.name)) for f in carried)], ["id", "n_words", "n_removed", "kept", *(f.name for f in carried)]))
        return pa.concat_tables(done)

    schema = ", ".join(["id bigint", "n_words bigint", "n_removed bigint", "kept string", *(f"{f.name} {f.dataType.simpleString()}" for f in carried)])
    placed = A.with_part(rows, log_p)
    empty = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut_or_nothing(table: pa.Table, flagged: pa.Table) -> pa.Table:
        return cut(table, flagged) if table.num_rows else empty.empty_table()

    return placed.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(S.lean_cogroup(cut_or_nothing), schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length_col: str = "n_chars", **how) -> DataFrame:
    """docs with repeated passages cut from the text, and their own columns.

    A document that loses all its words goes; one that loses none stays as it is.
    Where length_col exists, it is set to the new text's length for documents that lose words.
    """
    names = docs.columns
    others = [c for c in names if c != text_col]
    out = remove_repeats(docs, id_col, text_col, carry=others, layout="text", **how)
    back = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text_col: F.col("kept")}
    if length_col in others:
        back[length_col] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema[length_col].dataType)).otherwise(back[length_col])
    return out.where("n_removed = 0 OR n_removed < n_words").select(*(back[c].alias(c) for c in names))
