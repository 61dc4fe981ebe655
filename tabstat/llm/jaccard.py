"""N-gram Jaccard join: grouped prefix join over word shingles.

Documents with one shingle set are one class. Shingles are ordered by how many
documents have them (rare first, counted in a fixed-size sketch, ties by hash), and
classes with the same leading shingles (prefix) and size are one group. Two sets
whose similarity reaches the threshold share a prefix shingle, so groups meet by
shingle; group pairs pass the size and position filters, are expanded into their
members and verified on the texts.

Only components are asked for, so a pair inside one component needs no check. The
first round verifies one partner per group, which joins most copies; the second
takes every remaining pair across components. Groups of thousands of near copies
then cost about one check a member instead of one a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm import kernel as K
from tabstat.llm import spread as S

SHINGLE = 5
PERCENT = 80
#: Binary logarithm of the counters of the frequency sketch: 4 MB, and up to 64 MB on large inputs.
SKETCH_BITS = (20, 24)
_BLOCKS = 64
#: Most rows (16 bytes each) of a list of rows that go which is broadcast; a longer one is joined.
BROADCAST_ROWS = 2_000_000


class Sets:
    """Distinct shingle hashes of each text of a slice, ordered by (text, hash)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        words = K.Words(data, offsets, K.BLANK_WORDS)
        h = words.hashes()
        row = words.text_of_word()
        whole = words.room() >= size
        grams = K.window_hashes(h, size)
        at = np.flatnonzero(whole[: len(grams)])
        values, rows = [grams[at]], [row[at]]
        for few in range(1, size):
            short = np.flatnonzero(words.counts == few)
            if len(short):
                values.append(K.window_hashes(h, few)[words.first[short]])
                rows.append(short)
        value, row = np.concatenate(values), np.concatenate(rows)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))) if len(value) else np.empty(0, bool)
        self.value, self.row = value[new], row[new]
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self.n = np.diff(self.first)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit fingerprints of each set."""
        out = []
        for salt in (0, 0x632BE59BD9B4E019):
            c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(self.value ^ np.uint64(salt)))))
            out.append(K.mix(c[self.first[1:]] - c[self.first[:-1]]))
        return out[0], out[1]


def class_key(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit name of a class; its first column is the one that joins."""
    return K.mix(a ^ (b * np.uint64(3)) ^ n.astype(np.uint64)).view(np.int64)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-n * percent // 100) + 1


def sketch_bits(rows: DataFrame) -> int:
    """One counter for each 512 bytes of input, within SKETCH_BITS."""
    return min(max(int(S.size_bytes(rows) >> 9).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])


def _profile(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """Per document: id, sign, n, the class key; per task and block of the sketch: a bitmap of the counters met, and their counts.

    The counts of a block are as wide as its largest needs, so what a task sends follows what it read.
    """
    width = (1 << bits) // _BLOCKS
    kinds = {"id": pa.int64(), "sign": pa.int64(), "n": pa.int64(), "key": pa.int64(), "block": pa.int32(), "met": pa.binary(), "counts": pa.binary()}

    def scan(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            n, key = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, _, data, offsets in K.text_slices(batch.column(1)):
                sets = Sets(data, offsets, size)
                np.add.at(counts, (sets.value >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
                n.append(sets.n)
                key.append(class_key(*sets.prints(), sets.n))
            columns = {"id": batch.column(0), "sign": batch.column(2), "n": pa.array(np.concatenate(n)), "key": pa.array(np.concatenate(key))}
            yield pa.RecordBatch.from_pydict({c: columns.get(c, pa.nulls(batch.num_rows, k)) for c, k in kinds.items()})
        for i in range(_BLOCKS):
            own = counts[i * width : (i + 1) * width]
            found = own[own > 0]
            if len(found):
                columns = {"block": pa.array([i], pa.int32()), "met": pa.array([np.packbits(own > 0).tobytes()]), "counts": pa.array([found.astype(np.min_scalar_type(found.max())).tobytes()])}
                yield pa.RecordBatch.from_pydict({c: columns.get(c, pa.nulls(1, k)) for c, k in kinds.items()})

    return rows.select("id", "text", "sign").mapInArrow(S.lean(scan), "id bigint, sign bigint, n bigint, key bigint, block int, met binary, counts binary")


def _sketch(profile: DataFrame, bits: int) -> np.ndarray:
    """Sums of the tasks' counts: 2**bits numbers. A task adds up what comes in, row by row, and holds no more than the sketch."""
    width = (1 << bits) // _BLOCKS

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                total = held.setdefault(row["block"], np.zeros(width, np.uint32))
                at = np.flatnonzero(np.unpackbits(np.frombuffer(row["met"], np.uint8), count=width))
                n = np.frombuffer(row["counts"], f"u{len(row['counts']) // len(at)}")
                total[at] = np.minimum(total[at].astype(np.uint64) + n, 0xFFFFFFFF)
        for block, total in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([total.tobytes()])})

    out = np.zeros((_BLOCKS, width), np.uint32)
    for row in profile.where("block IS NOT NULL").select("block", "met", "counts").repartition("block").mapInArrow(S.lean(add), "block int, counts binary").collect():
        out[row.block] = np.frombuffer(row.counts, np.uint32)
    return out.reshape(-1)


_POST = "part int, kind binary, token binary, grp binary, n binary, pos binary"


def _postings(rows: DataFrame, sketch, bits: int, log_p: int, size: int, percent: int) -> DataFrame:
    """Prefix shingles of groups met by two groups or more (kind 0), and the classes of each group (kind 1)."""

    def scan(batches):
        for batch in batches:
            held = []
            for _, _, data, offsets in K.text_slices(batch.column(1)):
                sets = Sets(data, offsets, size)
                if not len(sets.value):
                    continue
                count = sketch.value[(sets.value >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((sets.value, count, sets.row))
                value = sets.value[order]
                place = np.arange(len(value)) - sets.first[sets.row]
                n = sets.n[sets.row]
                take = place < prefix_length(n, percent)
                value, place, n, row = value[take], place[take], n[take], sets.row[take]
                # Groups: the same prefix and size. The prefix is a set, as its order follows from it.
                c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(value ^ np.uint64(0x2545F4914F6CDD1D)))))
                edge = np.searchsorted(row, np.arange(len(sets.n) + 1))
                group = K.mix((c[edge[1:]] - c[edge[:-1]]) ^ (sets.n.astype(np.uint64) << np.uint64(40)))
                held.append((value, group[row], n.astype(np.int32), place.astype(np.int32), np.unique(np.stack((group[sets.n > 0], class_key(*sets.prints(), sets.n)[sets.n > 0].view(np.uint64))), axis=1)))
            if not held:
                continue
            value, group, n, place = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
            order = np.lexsort((group, value))
            value, group, n, place = value[order], group[order], n[order], place[order]
            new = np.concatenate(([True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])))
            value, group, n, place = value[new], group[new], n[new], place[new]
            members = np.unique(np.concatenate([x[4] for x in held], axis=1), axis=1)
            none = np.zeros(members.shape[1], np.int32)
            kind = np.concatenate((np.zeros(len(value), np.uint8), np.ones(members.shape[1], np.uint8)))
            token, grp = np.concatenate((value, members[1])), np.concatenate((group, members[0]))
            part = S.part_of(np.concatenate((value, members[0])), log_p)
            yield S.route(part, {"kind": kind, "token": token, "grp": grp, "n": np.concatenate((n, none)), "pos": np.concatenate((place, none))})

    def meet(table: pa.Table) -> pa.Table:
        kind, token, grp = S.unpack(table, "kind", np.uint8), S.unpack(table, "token", np.uint64), S.unpack(table, "grp", np.uint64)
        n, pos = S.unpack(table, "n", np.int32), S.unpack(table, "pos", np.int32)
        order = np.lexsort((grp, n, token, kind))
        kind, token, grp, n, pos = kind[order], token[order], grp[order], n[order], pos[order]
        new = np.concatenate(([True], (kind[1:] != kind[:-1]) | (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])))
        kind, token, grp, n, pos = kind[new], token[new], grp[new], n[new], pos[new]
        same = np.concatenate((token[1:] == token[:-1], [False])) & (kind == 0)
        shared = same | np.concatenate(([False], same[:-1])) | (kind > 0)
        return pa.table({"kind": pa.array(kind[shared].astype(np.int32)), "token": pa.array(token[shared].view(np.int64)), "grp": pa.array(grp[shared].view(np.int64)), "n": pa.array(n[shared]), "pos": pa.array(pos[shared])})

    return rows.select("id", "text").mapInArrow(S.lean(scan), _POST).groupBy("part").applyInArrow(S.lean_group(meet), "kind int, token bigint, grp bigint, n int, pos int")


def can_link(na: np.ndarray, at_a: np.ndarray, nb: np.ndarray, at_b: np.ndarray, percent: int) -> np.ndarray:
    """Size and position filters of two sets that share the shingle at these places."""
    need = -(-percent * (na + nb) // (100 + percent))
    most = np.minimum(at_a, at_b) + 1 + np.minimum(na - at_a - 1, nb - at_b - 1)
    return (np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb)) & (most >= need)


def _nearest(posts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Class pairs of the first round: two partners for each group, and neighbours inside groups.

    In a posting list a group meets the hub of its size class: the group with most
    shared prefix shingles, which in a family of edited copies is one close to the
    original. Size classes overlap by half, so that copies meet in one of them. Of
    all its hubs a group keeps the two that it meets most, if the shingles it meets
    them by are enough for a link. Hubs are found by partial aggregation, however
    long a list is.
    """
    fame = posts.groupBy("grp").agg(F.count("*").alias("fame"))
    step = np.log(100 / percent)
    classes = F.array(*(F.floor(F.log("n") / step + shift / 2).cast("int") * 2 + shift for shift in (0, 1)))
    listed = posts.join(fame, "grp").select("token", "grp", "n", "fame", F.explode(classes).alias("cls"))
    hubs = listed.groupBy("token", "cls").agg(F.max(F.struct("fame", "grp", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("token", "cls", F.col("hub.grp").alias("other"), F.col("hub.n").alias("m"))
    # A pair may share a list in both of its size classes: it counts once.
    met = listed.join(hubs, ["token", "cls"]).where(f"grp <> other AND least(n, m) * 100 >= {percent} * greatest(n, m)").select("token", "grp", "other", "n", "m").distinct().groupBy("grp", "other", "n", "m").count()
    met = met.where(f"count + ceil({percent} * greatest(n, m) / 100) - 1 >= ceil({percent} * (n + m) / {100 + percent})")
    ranked = met.groupBy("grp").agg(F.expr("slice(sort_array(collect_list(struct(count, other)), false), 1, 2)").alias("top"))
    best = ranked.select("grp", F.explode("top").alias("t")).select("grp", F.col("t.other").alias("other"))
    head = members.groupBy("grp").agg(F.min("key").alias("key"))
    across = best.join(head, "grp").select(F.col("key").alias("a"), F.col("other").alias("grp")).join(head, "grp").select("a", F.col("key").alias("b"))
    inside = members.join(head.withColumnRenamed("key", "a"), "grp").where("key <> a").select("a", F.col("key").alias("b"))
    return across.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def cross_pairs(token: np.ndarray, component: np.ndarray, step: int = 1 << 20):
    """Index pairs of entries of one token and different components, in blocks; token is sorted.

    Entries of a list's commonest component only meet the others, so a list of one
    component and a few strays costs its length for each stray.
    """
    edge = np.append(K.runs(token), len(token))
    of_list = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    order = np.lexsort((component, of_list))
    c, t = component[order], of_list[order]
    first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])))) if len(c) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(c)))
    top = np.lexsort((n, t[first]))
    last = np.append(K.runs(t[first][top]), len(top))[1:] - 1
    common = c[first][top][last]
    stray = np.flatnonzero(component != common[of_list]) if len(c) else np.empty(0, np.int64)
    width = np.diff(edge)[of_list[stray]]
    ends = np.cumsum(width)
    low = 0
    while low < len(stray):
        base = ends[low] - width[low]
        high = max(low + 1, int(np.searchsorted(ends, base + step, "right")))
        i = np.repeat(stray[low:high], width[low:high])
        j = np.arange(len(i)) - np.repeat(ends[low:high] - width[low:high] - base, width[low:high]) + np.repeat(edge[of_list[stray[low:high]]], width[low:high])
        fit = (component[i] != component[j]) & ((component[j] == common[of_list[j]]) | (i < j))
        yield i[fit], j[fit]
        low = high


#: Columns of pairs on their way: groups, sizes, shared shingles.
_PAIR = {"ga": np.int64, "gb": np.int64, "na": np.int32, "nb": np.int32, "met": np.int32}


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    """Columns (ga, gb, na, nb, met), one for each pair, met summed."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort(rows[1::-1])]
    if not rows.shape[1]:
        return rows
    new = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))))
    return np.concatenate((rows[:4, new], np.add.reduceat(rows[4], new)[None]))


def _send(rows: np.ndarray, log_p: int) -> pa.RecordBatch:
    both = rows[0].view(np.uint64) ^ K.mix(rows[1].view(np.uint64))
    return S.route(S.part_of(K.mix(both), log_p), {c: rows[i].astype(k) for i, (c, k) in enumerate(_PAIR.items())})


def _within(members: DataFrame) -> DataFrame:
    """Class pairs of one group and different components. members: grp, key, component.

    Classes of a group share size and prefix, so every filter lets them pass. As in
    cross_pairs, classes of the group's commonest component only meet the others.
    """
    tally = members.groupBy("grp", "component").agg(F.count("*").alias("c"))
    common = tally.groupBy("grp").agg(F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("grp", F.col("most.component").alias("common"))
    mixed = members.join(common, "grp")
    stray = mixed.where("component <> common").select("grp", F.col("key").alias("a"), F.col("component").alias("ca"))
    both = stray.join(mixed, "grp").where("component <> ca AND (component = common OR a < key)")
    return both.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b"))


def _remaining(posts: DataFrame, members: DataFrame, log_p: int, percent: int) -> DataFrame:
    """Class pairs across components that pass the filters. members: grp, key, component.

    Pairs inside a group come from its members, as its shingles are posted only if
    another group has them; pairs of two groups come from the posts.

    Besides size and position, a pair must share enough of its prefixes: what two
    sets share lies in both prefixes, or past the prefix of the one whose prefix
    ends first. Pairs travel packed to where all their shingles are counted.
    """
    parts = members.select("grp", "component").distinct()
    entries = posts.join(parts, "grp").select("token", "grp", "n", "pos", "component")
    mixed = entries.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    entries = entries.join(mixed, "token").withColumn("part", F.pmod(F.xxhash64("token"), F.lit(1 << log_p)).cast("int"))

    def pair(table: pa.Table) -> pa.Table:
        token, grp, component = (table.column(c).to_numpy() for c in ("token", "grp", "component"))
        n, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "pos"))
        order = np.lexsort((grp, n, token))
        token, grp, component, n, pos = token[order], grp[order], component[order], n[order], pos[order]
        done, held, waiting = np.empty((5, 0), np.int64), [], 0
        for i, j in cross_pairs(token, component):
            ok = (grp[i] != grp[j]) & can_link(n[i], pos[i], n[j], pos[j], percent)
            i, j = i[ok], j[ok]
            swap = grp[i] > grp[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            held.append(np.stack((grp[i], grp[j], n[i], n[j], np.ones(len(i), np.int64))))
            waiting += len(i)
            if waiting > 500_000:
                done, held, waiting = _fold([done, *held]), [], 0
        return pa.Table.from_batches([_send(_fold([done, *held]), log_p)])

    def merge(table: pa.Table) -> pa.Table:
        # The pair's lists meet here: how many prefix shingles it shares in all decides.
        ga, gb, na, nb, met = _fold([np.stack([S.unpack(table, c, k).astype(np.int64) for c, k in _PAIR.items()])])
        need = -(-percent * (na + nb) // (100 + percent))
        past = -(-percent * np.maximum(na, nb) // 100) - 1
        fit = met + past >= need
        return pa.table({"ga": pa.array(ga[fit]), "gb": pa.array(gb[fit])})

    sent = entries.groupBy("part").applyInArrow(S.lean_group(pair), "part int, " + ", ".join(f"{c} binary" for c in _PAIR))
    pairs = sent.groupBy("part").applyInArrow(S.lean_group(merge), "ga bigint, gb bigint")
    a = members.select(F.col("grp").alias("ga"), F.col("component").alias("ca"), F.col("key").alias("a"))
    b = members.select(F.col("grp").alias("gb"), F.col("component").alias("cb"), F.col("key").alias("b"))
    both = pairs.join(a, "ga").join(b, "gb").where("ca <> cb")
    across = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    return across.union(_within(members)).distinct()


def _fetch(rows: DataFrame, wanted: DataFrame, scratch: S.Scratch, log_p: int, size: int) -> DataFrame:
    """Table (key, text) of the wanted (key, rep): a bitmap of ids spares the other texts the shuffle."""
    log_p = S.bitmap_parts(log_p)
    bits = rows.sparkSession.sparkContext.broadcast(S.bitmap(S.id_hashes(wanted.select("rep"), log_p), log_p)[0])

    def scan(batches):
        for batch in batches:
            ids = S.ids_of(batch)
            mine = S.in_bitmap(bits.value, K.mix(ids.view(np.uint64)), log_p)
            text = batch.column(1).filter(pa.array(mine))
            key = [np.empty(0, np.int64)]
            for _, _, data, offsets in K.text_slices(text):
                sets = Sets(data, offsets, size)
                key.append(class_key(*sets.prints(), sets.n))
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(key)), "rep": pa.array(ids[mine]), "text": text})

    found = rows.select("id", "text").mapInArrow(S.lean(scan), "key bigint, rep bigint, text string")
    out = scratch.table(found.join(wanted, ["key", "rep"], "left_semi").dropDuplicates(["key"]).select("key", "text"))
    bits.destroy()
    return out


def _verified(rows: DataFrame, pairs: DataFrame, classes: DataFrame, scratch: S.Scratch, log_p: int, size: int, percent: int) -> DataFrame:
    """Those of the class pairs whose similarity reaches the threshold, by the texts of the classes in pairs."""
    pairs = scratch.table(pairs)
    scratch.sweep()
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(classes, "key").select("key", F.coalesce("rep", F.lit(int(S.NULL_ID))).alias("rep"))
    wanted = scratch.table(wanted)
    texts = _fetch(rows, wanted, scratch, log_p, size)
    scratch.sweep()

    def check(batches):
        for batch in batches:
            a, b, keep = batch.column(2), batch.column(3), []
            # Linked sets have sizes of one order, so slices by one side's bytes bound the other's too.
            for low, high, data, offsets in K.text_slices(a):
                one = Sets(data, offsets, size)
                other_data, other_offsets = K.buffers(b.slice(low, high - low))
                two = Sets(other_data[other_offsets[0] : other_offsets[-1]], other_offsets - other_offsets[0], size)
                value, row = np.concatenate((one.value, two.value)), np.concatenate((one.row, two.row))
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                both = np.bincount(row[1:][(value[1:] == value[:-1]) & (row[1:] == row[:-1])], minlength=high - low)
                keep.append(100 * both >= percent * (one.n + two.n - both))
            mask = pa.array(np.concatenate(keep)) if keep else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    out = scratch.table(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(S.lean(check), "a bigint, b bigint"))
    scratch.free(pairs, wanted, texts)
    scratch.sweep()
    return out


def _links(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, scratch: S.Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, sign, n, key), classes of equal sets (key, rep: least id, null if they have none), and links (a, b) of classes.

    The links join all classes that are similar, if not pair by pair.
    """
    if size < 1 or not 50 <= percent <= 100:
        raise ValueError("size must be positive and percent 50 to 100")
    spark = docs.sparkSession
    S.tune(spark)
    rows = S.texts(docs, id_col, text_col).select("id", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text"), F.xxhash64("text").alias("sign"))
    log_p = S.log_parts(rows)
    bits = sketch_bits(rows)
    profile = scratch.table(_profile(rows, size, bits))
    scratch.sweep()
    documents = profile.where("block IS NULL").select("id", "sign", "n", "key")
    classes = scratch.table(documents.where("n > 0").groupBy("key").agg(F.min("id").alias("rep")))
    sketch = spark.sparkContext.broadcast(_sketch(profile, bits))
    met = scratch.table(_postings(rows, sketch, bits, log_p, size, percent))
    sketch.destroy()
    scratch.sweep()
    posts = met.where("kind = 0").drop("kind")
    members = met.where("kind = 1").select("grp", F.col("token").alias("key")).distinct()
    shared = posts.select("grp").union(members.groupBy("grp").count().where("count > 1").select("grp")).distinct()
    members = scratch.table(members.join(shared, "grp", "left_semi"))
    first = _verified(rows, _nearest(posts, members, percent), classes, scratch, log_p, size, percent)
    joined = scratch.table(S.components(first, scratch))
    own = scratch.table(members.join(joined, members.key == joined.node, "left").select("grp", "key", F.coalesce("component", "key").alias("component")))
    second = _verified(rows, _remaining(posts, own, log_p, percent), classes, scratch, log_p, size, percent)
    scratch.free(met, members, joined, own)
    return documents, classes, first.union(second)


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Components of documents under Jaccard similarity of word shingles.

    A document's set is its distinct ``size``-word shingles, the whole sequence if
    it has fewer words. Words are runs of non-blank characters with A-Z
    lower-cased. Documents link when 100 * intersection >= percent * union. Returns
    one row per input row, from a table in the shared folder: ``id``, ``n_shingles``
    and ``component``, the least id that links lead to.

    Null, empty or blank texts have an empty set and link with nothing. Rows that
    share an id are one node with the links of all their texts. Each row with a
    null id is a node of its own: it links as its text does and never names a
    component; a component of such rows alone is null. Other columns are not read.
    Sets are named by 64-bit fingerprints and compared by 64-bit shingle hashes.
    """
    scratch = S.Scratch(docs.sparkSession)
    documents, classes, links = _links(docs, id_col, text_col, size, percent, scratch)
    # Ids with several sets tie them together; an empty set is none's link but follows its id.
    several = scratch.table(documents.where("id IS NOT NULL").groupBy("id").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.min(F.when(F.col("n") > 0, F.col("key"))).alias("a")).where("x <> y").select("id", "a"))
    ties = documents.where("n > 0").join(several, "id").select("a", F.col("key").alias("b")).distinct()
    final = scratch.table(S.components(links.union(ties), scratch))
    named = classes.join(final, classes.key == final.node, "left").select("key", F.coalesce("component", "key").alias("tie"), "rep")
    named = scratch.table(named)
    scratch.sweep()
    least = named.groupBy("tie").agg(F.min("rep").alias("component"))
    of_class = named.join(least, "tie").select("key", "component")
    out = documents.join(of_class, "key", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
    if not several.isEmpty():
        tied = out.join(several.select("id"), "id").groupBy("id").agg(F.min("component").alias("least"))
        out = out.join(tied, "id", "left").select("id", "n_shingles", F.coalesce("least", "component").alias("component"))
    result = scratch.keep(scratch.table(out))
    scratch.free()
    return result


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of linked texts: the one with the least id, null ids last.

    Only texts link here: rows that share an id but not the text are judged by
    their texts. Of rows equal in id and text one stays, whichever it is. Rows
    without words stay. The list of rows that go is a table in the shared folder;
    it is broadcast while small.
    """
    scratch = S.Scratch(docs.sparkSession)
    documents, classes, links = _links(docs, id_col, text_col, size, percent, scratch)
    final = scratch.table(S.components(links, scratch))
    of_class = classes.join(final, classes.key == final.node, "left").select("key", F.coalesce("component", "key").alias("component"))
    own = documents.where("n > 0").join(of_class, "key").select("component", F.struct(F.col("id").isNull().alias("none"), "id", "key", "sign").alias("row"))
    best = own.groupBy("component").agg(F.min("row").alias("best"), F.count("*").alias("c")).where("c > 1").drop("c")
    listed = own.join(best, "component").select("row.id", "row.sign", (F.col("row.id").eqNullSafe(F.col("best.id")) & (F.col("row.sign") == F.col("best.sign"))).alias("best"))
    listed = scratch.table(listed.groupBy("id", "sign", "best").agg(F.count("*").alias("c")))
    scratch.sweep()
    gone = scratch.keep(scratch.table(listed.where("NOT best").select(F.col("id").alias("i"), F.col("sign").alias("s")).distinct()))
    again = scratch.keep(scratch.table(listed.where("best AND c > 1").select(F.col("id").alias("i"), F.col("sign").alias("s"))))
    scratch.free()
    few = gone.count() <= BROADCAST_ROWS
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("bigint").alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("sign"))
    match = F.col("id").eqNullSafe(F.col("i")) & (F.col("sign") == F.col("s"))
    rows = rows.join(F.broadcast(gone) if few else gone, match, "left_anti")
    if not again.isEmpty():
        repeated = rows.join(again, match, "left_semi").groupBy("id", "sign").agg(F.first("row").alias("row"))
        rows = rows.join(again, match, "left_anti").select("row").union(repeated.select("row"))
    return rows.select("row.*")
