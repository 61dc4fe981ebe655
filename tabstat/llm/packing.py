"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm import kernel as K
from tabstat.llm import spread as S
from tabstat.llm.anchors import string_array
from tabstat.llm.substrings import join_words

#: Permitted sequence lengths, in words.
CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Documents that one task packs, about: enough for full bins, and few enough for one Python list.
SHARD_DOCUMENTS = 20_000


def cost(capacity: int) -> float:
    """Cost of a sequence: linear work, attention that grows with the square, and a fixed part."""
    return 16.0 + capacity + capacity * capacity / 16384


def fill_bins(lengths: Sequence[int], opens: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """Bins of items in falling length: best fit, where a new bin's size is that of the item's class.

    opens: by permitted size, the size that an item opens which needs this one at
    least. Bins are downsized to their contents at the end.
    """
    sizes = sorted(opens)
    bins, place = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    rooms: dict[int, list[int]] = {}
    mask = 0
    for i, n in enumerate(lengths):
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room = opens[next(c for c in sizes if c >= n)]
            b = len(used)
            used.append(0)
        bins[i], place[i] = b, used[b]
        used[b] += n
        rest = room - n
        if rest:
            rooms.setdefault(rest, []).append(b)
            mask |= 1 << rest
    return bins, place, [next(c for c in sizes if c >= u) for u in used]


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, place in it, capacity of each bin). Every length must fit the largest capacity.

    Items go in falling length into the open bin with the least room that holds
    them. Which size to open where none does is chosen for all sizes together:
    items of each size class (those that need the same least size) open bins of one
    size, and the sizes of the classes are improved in turn, from the best single
    size on, until no change lowers the cost of the bins, downsized to their
    contents. The result never costs more than with the best single size.
    """
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    falling = [lengths[i] for i in order]
    price = {c: cost(c) for c in sizes}
    total = lambda found: sum(price[c] for c in found[2])
    tried = [(total(found), limit, found) for limit in sizes for found in [fill_bins(falling, {c: max(c, limit) for c in sizes})]]
    best_cost, limit, best = min(tried, key=lambda t: t[:2])
    # The size that the items of each class open: the class's own, or the limit if that is larger.
    opens = {c: max(c, limit) for c in sizes}
    changed = len(lengths) > 0
    while changed:
        changed = False
        for c in sizes:
            for other in sizes:
                if other < c or other == opens[c]:
                    continue
                found = fill_bins(falling, opens | {c: other})
                if total(found) < best_cost:
                    best_cost, best, opens, changed = total(found), found, opens | {c: other}, True
    bins, place = [0] * len(lengths), [0] * len(lengths)
    for k, i in enumerate(order):
        bins[i], place[i] = best[0][k], best[1][k]
    return bins, place, best[2]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacities: Sequence[int] = CAPACITIES, shard_documents: int = SHARD_DOCUMENTS, with_text: bool = False) -> DataFrame:
    """Packs all words of all documents into bins of permitted lengths.

    Returns one row per piece: ``id``, ``piece``, ``start`` (first word), ``n_words``,
    ``shard``, ``bin``, ``place`` (words before it in the bin), ``capacity``, and with
    with_text the piece's words as ``text``, joined by one space. A document
    longer than the largest capacity is cut into pieces of that length and a rest. Shards are packed
    on their own; a document's shard follows from its id and text, and so does its
    place among equally long ones, so a run can be repeated.

    Null, empty and blank texts have no words and one piece of length 0 with a null
    bin, place and capacity. Null and repeated ids are packed row by row; rows equal
    in id and text are numbered, and it doesn't matter which of them has which
    number. Other columns are not read. An empty table gives no rows.
    """
    sizes = tuple(sorted(set(capacities)))
    if not sizes or sizes[0] < 1:
        raise ValueError("capacities must be positive")
    S.tune(docs.sparkSession)
    rows = S.texts(docs, id_col, text_col)
    shards = max(1, -(-rows.count() // shard_documents))
    top = sizes[-1]

    def measure(batches):
        for batch in batches:
            n, key, text = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [pa.array([], pa.string())]
            keyed = S.ids_of(batch)
            for low, high, data, offsets in K.text_slices(batch.column(1)):
                words = K.Words(data, offsets, K.BLANK_WORDS)
                n.append(words.counts)
                key.append(K.mix(S.text_keys(data, offsets) ^ K.mix(keyed[low:high].view(np.uint64))))
                if with_text:
                    text.append(string_array(*join_words(words, np.ones(len(words.start), bool))))
            columns = {"id": batch.column(0), "n": pa.array(np.concatenate(n)), "key": pa.array(np.concatenate(key).view(np.int64))}
            if with_text:
                columns["text"] = pa.concat_arrays(text)
            yield pa.RecordBatch.from_pydict(columns)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("key", "ascending"), ("id", "ascending")])
        n, copies, shard = table.column("n").to_pylist(), table.column("copies").to_pylist(), table.column("shard")[0].as_py()
        pieces = [(i, p, min(top, size - p * top), c) for i, size in enumerate(n) for c in range(copies[i]) for p in range(max(1, -(-size // top)))]
        full = [k for k, p in enumerate(pieces) if p[2]]
        bins, place, capacity = best_fit([pieces[k][2] for k in full], sizes)
        found: list[tuple] = [(None, None, None)] * len(pieces)
        for k, b, at in zip(full, bins, place, strict=True):
            found[k] = (b, at, capacity[b])
        row = pa.array([p[0] for p in pieces], pa.int64())
        out = {"id": table.column("id").take(row), "key": table.column("key").take(row), "copy": pa.array([p[3] for p in pieces], pa.int64()), "piece": pa.array([p[1] for p in pieces], pa.int32()), "start": pa.array([p[1] * top for p in pieces], pa.int64()), "n_words": pa.array([p[2] for p in pieces], pa.int64()), "shard": pa.array([shard] * len(pieces), pa.int32())}
        out |= {c: pa.array([f[j] for f in found], pa.int32()) for j, c in enumerate(("bin", "place", "capacity"))}
        return pa.table(out)

    lengths = rows.mapInArrow(S.lean(measure), "id bigint, n bigint, key bigint" + (", text string" if with_text else ""))
    # Rows equal in id and text travel as one with their number, cut into shards' shares: they neither pile up nor depend on batches.
    counted = lengths.groupBy("id", "n", "key").agg(F.count("*").alias("copies"))
    share = max(1, shard_documents // 4)
    counted = counted.select("id", "n", "key", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / share))).alias("k"), "copies").select("id", "n", "key", "k", F.least(F.col("copies") - F.col("k") * share, F.lit(share)).alias("copies"))
    counted = counted.withColumn("shard", F.pmod(F.xxhash64("key", "k"), F.lit(shards)).cast("int"))
    kinds = "id bigint, key bigint, copy bigint, piece int, start bigint, n_words bigint, shard int, bin int, place int, capacity int"
    out = counted.groupBy("shard").applyInArrow(S.lean_group(fill), kinds)
    names = ["id", "piece", "start", "n_words", "shard", "bin", "place", "capacity"]
    if not with_text:
        return out.select(names)
    # Each text meets its places; copies share one text.
    once = lengths.select(F.col("id").alias("i"), F.col("key").alias("k"), "text").groupBy("i", "k").agg(F.first("text").alias("text"))
    both = out.join(once, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
    words = F.slice(F.split("text", " "), F.col("start").cast("int") + 1, F.col("n_words").cast("int"))
    return both.select(*names, F.when(F.col("n_words") > 0, F.array_join(words, " ")).otherwise("").alias("text"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences, one row per bin: ``shard``, ``bin``, ``capacity``, ``n_words``, ``text`` (pieces in place, joined by one space), ``ids`` (of the pieces, in place).

    packed is pack(..., with_text=True). Pieces without words are in no sequence.
    """
    pieces = packed.where("bin IS NOT NULL").groupBy("shard", "bin").agg(F.max("capacity").alias("capacity"), F.sum("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("place", "id", "text"))).alias("parts"))
    return pieces.select("shard", "bin", "capacity", "n_words", F.array_join(F.col("parts.text"), " ").alias("text"), F.col("parts.id").alias("ids"))
