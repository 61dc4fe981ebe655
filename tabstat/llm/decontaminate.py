"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm import kernel as K
from tabstat.llm import spread as S

N = 10
#: Benchmark text in one broadcast, in bytes. A larger benchmark is scanned in as many blocks.
BLOCK_BYTES = 16 << 20

_HITS = "id bigint, n_words bigint, starts array<int>, lengths array<int>, items array<string>"


class _Grams:
    """Windows of some items by length: sorted hashes, and for each window's words the number of its set of items.

    Sets of items are numbered, so that a hit costs one number however many items
    share its window.
    """

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        found: dict[int, dict[bytes, list[str]]] = {}
        for item, text in items:
            data = K.LOWER[np.frombuffer(text, np.uint8)]
            words = K.Words(data, np.array([0, len(data)]), K.ALNUM_WORDS)
            spans = [data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
            size = min(n, len(spans))
            for i in range(len(spans) - size + 1 if size else 0):
                owners = found.setdefault(size, {}).setdefault(b" ".join(spans[i : i + size]), [])
                if owners[-1:] != [item]:
                    owners.append(item)
        sets: dict[tuple[str, ...], int] = {}
        self.by_length = {}
        for size, grams in found.items():
            joined = b"\n".join(grams)
            data = np.frombuffer(joined, np.uint8)
            words = K.Words(data, np.array([0, len(data)]), K.ALNUM_WORDS)
            hashes = K.window_hashes(words.hashes(), size)[::size]
            keep = np.unique(hashes)
            few = np.zeros(1 << 20, bool)
            few[(keep & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.by_length[size] = (few, keep, {g: sets.setdefault(tuple(o), len(sets)) for g, o in grams.items()})
        self.sets = list(sets)


def _scan(docs: DataFrame, block, first: bool) -> DataFrame:
    """Adds a block's verified hits to each row: starts, lengths and items of windows."""

    def scan(batches):
        for batch in batches:
            n_words, hits = [], []
            for _, _, raw, offsets in K.text_slices(batch.column(1)):
                data = K.LOWER[raw]
                words = K.Words(data, offsets, K.ALNUM_WORDS)
                n_words.append(words.counts)
                rows = [([], [], set()) for _ in words.counts]
                h, room, row = words.hashes(), words.room(), None
                for size, (few, keep, grams) in block.value.by_length.items():
                    g = K.window_hashes(h, size)
                    at = np.flatnonzero(few[(g & np.uint64(0xFFFFF)).astype(np.int64)] & (room[: len(g)] >= size))
                    at = at[keep[np.minimum(np.searchsorted(keep, g[at]), len(keep) - 1)] == g[at]]
                    if len(at) and row is None:
                        row = words.text_of_word()
                    for i in at.tolist():
                        owners = grams.get(b" ".join(data[a:b].tobytes() for a, b in zip(words.start[i : i + size], words.end[i : i + size], strict=True)))
                        if owners is not None:
                            r = int(row[i])
                            rows[r][0].append(i - int(words.first[r]))
                            rows[r][1].append(size)
                            rows[r][2].add(owners)
                hits += rows
            starts, lengths, owners = zip(*hits, strict=True) if hits else ((), (), ())
            items = [list(set().union(*(block.value.sets[k] for k in own))) for own in owners]
            if not first:
                before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("starts", "lengths", "items")]
                starts, lengths, items = ([a + b for a, b in zip(x, y, strict=True)] for x, y in zip(before, (starts, lengths, items), strict=True))
            out = {"id": batch.column(0), "text": batch.column(1)}
            out |= {"n_words": pa.array(np.concatenate(n_words) if n_words else np.empty(0, np.int64), pa.int64()), "starts": pa.array(starts, pa.list_(pa.int32())), "lengths": pa.array(lengths, pa.list_(pa.int32())), "items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))}
            out |= {f: batch.column(batch.schema.get_field_index(f)) for f in batch.schema.names if f[0] == "c" and f[1:].isdigit()}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    carried = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name[0] == "c" and f.name[1:].isdigit()]
    return docs.mapInArrow(S.lean(scan), ", ".join([_HITS.replace("id bigint,", "id bigint, text string,"), *carried]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", n: int = N, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of benchmark windows in every document.

    A window is n consecutive words of an item, or the whole of an item of fewer
    words. Words are runs of letters, digits and non-ASCII characters, with A-Z
    lower-cased. Returns one row per document: ``id``, ``text``, ``n_words``,
    ``starts`` and ``lengths`` (in words) of the hits, ``items`` (distinct ids as
    sorted strings) and carried columns as c0, c1, ... Each hash hit is verified
    on the words themselves.

    The benchmark's size is measured first: a block of at most about block_bytes
    of it is broadcast at a time, so a benchmark of any size is scanned whole.

    Null or empty text: no words and no hits. Items without words have no window;
    items with a null id are named "null"; rows that repeat an id are one item.
    Repeated documents each get their row. An empty benchmark gives no hits.
    """
    if n < 1 or block_bytes < 1:
        raise ValueError("n and block_bytes must be positive")
    spark = docs.sparkSession
    S.tune(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    out = S.texts(docs, id_col, text_col, carry)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        grams = _Grams([(r.item, r.text.encode()) for r in own], n)
        out = _scan(out, spark.sparkContext.broadcast(grams), b == 0)
    return out


def leak_digest(found: DataFrame) -> DataFrame:
    """Of find_leaks: ``id``, ``n_words``, ``n_hit`` (words inside any hit), ``items``."""
    return found.select("id", "n_words", F.size("starts").alias("n"), "starts", "lengths", "items").select(
        "id",
        "n_words",
        # Starts ascend within a length only; sorted, each span adds what lies past the furthest end so far.
        F.expr("""aggregate(array_sort(arrays_zip(starts, lengths)), named_struct('n', 0L, 'end', 0),
            (s, x) -> named_struct('n', s.n + greatest(0, x.starts + x.lengths - greatest(x.starts, s.end)), 'end', greatest(s.end, x.starts + x.lengths)), s -> s.n)""").alias("n_hit"),
        "items",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, remove: str = "documents", **how) -> DataFrame:
    """The documents without what leaked: whole documents go, or (remove="spans") only the hit words.

    Keeps docs' columns. Cut spans run from a hit's first word to the next word
    after it, so what follows stays whole. Documents without hits stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be documents or spans")
    names = docs.columns
    others = [c for c in names if c != text_col]
    back = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(others)} | {text_col: F.col("text").alias(text_col)}
    found = find_leaks(docs, benchmark, id_col, text_col, carry=others, **how)
    if remove == "documents":
        return found.where(F.size("starts") == 0).select(*(back[c] for c in names))

    def cut(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            starts, lengths, out = batch.column(at("starts")).to_pylist(), batch.column(at("lengths")).to_pylist(), []
            texts = batch.column(at("text"))
            for i, spans in enumerate(starts):
                if not spans:
                    out.append(texts[i].as_py())
                    continue
                raw = texts[i].as_py().encode()
                data = np.frombuffer(raw, np.uint8)
                words = K.Words(K.LOWER[data], np.array([0, len(data)]), K.ALNUM_WORDS)
                edge = np.append(words.start, len(data))
                keep = np.ones(len(data), bool)
                for s, n in zip(spans, lengths[i], strict=True):
                    keep[edge[s] : edge[s + n]] = False
                out.append(data[keep].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(j) if c != "text" else pa.array(out, pa.string()) for j, c in enumerate(batch.schema.names)], batch.schema.names)

    return found.mapInArrow(S.lean(cut), found.schema).select(*(back[c] for c in names))
