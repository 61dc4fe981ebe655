"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

A document's score is the mean, over its hashed word unigrams and bigrams, of the
log ratio between two smoothed multinomials: trusted target documents and the raw
corpus. Weights are rounded to millionths and summed as integers, so that a score
doesn't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Buckets of the two multinomials: the model is this many numbers at any input size.
BUCKETS = 1 << 14
#: Share of a uniform distribution that is mixed into both, so that smoothing weighs alike at any corpus size.
SMOOTHING = 0.1
#: Target documents: at most so many trusted labels, those with the least md5 of the id.
TARGET_DOCUMENTS = 20_000
#: Least mean log ratio of a kept document, in millionths. Set on held-out labels (README).
THRESHOLD = -40_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), F.lit(""))


def hashed(words: str = "words") -> Column:
    """A 60-bit number of each word: the head of its md5, which any SQL engine has."""
    return F.expr(f"transform({words}, w -> cast(conv(substr(md5(cast(w AS binary)), 1, 15), 16, 10) AS bigint))")


def _pair(x: str, y: str, buckets: int) -> str:
    return f"cast(({x} % 1048576 * 31 + {y}) % {buckets} AS int)"


def _repeat_words(rows: DataFrame, window: int) -> DataFrame:
    """Adds n_repeat_words: words inside windows of the hashed words h met twice or more in the text."""
    # The array is bound to a lambda variable, as reading a column costs an allocation per element.
    items = ", ".join(f"z[i + {k}]" for k in range(1, window))
    rows = rows.withColumn("win", F.expr(f"CASE WHEN size(h) >= {window} THEN transform(array(h), z -> transform(slice(z, 1, size(z) - {window - 1}), (x, i) -> xxhash64(x, {items})))[0] ELSE array() END"))
    # Only texts with a repeated window are sorted: equal windows become neighbours.
    rows = rows.withColumn("win", F.expr("CASE WHEN size(array_distinct(win)) < size(win) THEN array_sort(transform(win, (x, i) -> struct(x AS x, i AS i))) ELSE array() END"))
    rows = rows.withColumn("win", F.expr("sort_array(transform(filter(win, (s, k) -> (k > 0 AND win[k - 1].x = s.x) OR (k < size(win) - 1 AND win[k + 1].x = s.x)), s -> s.i))"))
    covered = F.expr(f"aggregate(win, struct(0L AS n, 0 AS e), (s, p) -> struct(s.n + p + {window} - greatest(p, s.e) AS n, p + {window} AS e), s -> s.n)")
    return rows.withColumn("n_repeat_words", covered).drop("win")


def target_ids(labels: DataFrame, id_col: str = "doc_id", most: int = TARGET_DOCUMENTS) -> DataFrame:
    """Ids of trusted documents: quality 1 and not toxic; at most `most`, by the md5 of the id."""
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col(id_col).cast("bigint").alias("target")).where("target IS NOT NULL").distinct()
    return trusted.orderBy(F.md5(F.col("target").cast("string").cast("binary")), "target").limit(most)


def weights(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row, ``weights``: each bucket's log ratio in millionths. Counts cover all documents.

    Without target documents every weight is 0.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), words_of(F.col(text_col)).alias("words")).select("id", hashed().alias("h"))
    rows = rows.join(F.broadcast(targets), rows.id == targets.target, "left")
    # explode_outer: explode would put a filter on the array below, which hashes every word again.
    rows = rows.select(F.when(F.col("target").isNotNull(), 1).otherwise(0).alias("t"), F.explode_outer(F.arrays_zip("h", F.expr("slice(h, 2, size(h))").alias("y"))).alias("z"))
    rows = rows.select("t", F.expr(f"stack(2, cast(z.h % {buckets} AS int), {_pair('z.h', 'z.y', buckets)})").alias("b"))
    counts = rows.groupBy("b").agg(F.count("b").alias("r"), F.sum("t").alias("t"))
    counts = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    # The window is over the buckets, whose number is fixed.
    total = counts.agg(F.sum("r").alias("rs"), F.sum("t").alias("ts"), F.array_sort(F.collect_list(F.struct("b", "r", "t"))).alias("c"))
    a = f"{smoothing / buckets!r}D"
    return total.select(F.expr(f"transform(c, x -> CASE WHEN ts = 0 THEN 0L ELSE cast(round((ln(cast(x.t AS double) / ts + {a}) - ln(cast(x.r AS double) / rs + {a})) * 1e6D) AS bigint) END)").alias("weights"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_id_col: str = "doc_id", buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: int = THRESHOLD, most: int = TARGET_DOCUMENTS, window: int = WINDOW, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Counts, base rules and verdict of every document.

    Returns one row per input row, in a struct ``row`` its columns, and: n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score (sum of
    weights in millionths), n_grams, kept. A document passes when its base rules
    hold and its mean weight is at least the threshold.

    Null, empty and blank texts have no words and fail the base rules. Rows with a
    null or repeated id are judged one by one; an id that is a target counts with
    all its rows. Empty labels leave the verdict to the base rules. docs' columns
    may have any names: they travel in ``row``.
    """
    model = weights(docs, target_ids(labels, label_id_col, most), id_col, text_col, buckets=buckets, smoothing=smoothing)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    rows = rows.select(
        "row",
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")).drop("lines")
    rows = rows.withColumn("h", hashed()).drop("words")
    rows = _repeat_words(rows, window).withColumn("weights", model.scalar())
    single = F.expr(f"aggregate(h, 0L, (s, x) -> s + weights[cast(x % {buckets} AS int)])")
    double = F.expr(f"CASE WHEN size(h) > 1 THEN aggregate(zip_with(slice(h, 1, size(h) - 1), slice(h, 2, size(h)), (x, y) -> weights[{_pair('x', 'y', buckets)}]), 0L, (s, w) -> s + w) ELSE 0L END")
    rows = rows.withColumn("score", single + double).withColumn("n_grams", F.expr("cast(greatest(2 * n_words - 1, 0) AS bigint)")).drop("h", "weights")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("n_grams") * threshold))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The filter also reads a row number, which keeps Catalyst from moving it below
    the projections and working out each count once for every use.
    """
    judged = judge(docs, labels, id_col, text_col, **how)
    return judged.select("row", "kept", F.monotonically_increasing_id().alias("at")).where("kept AND at >= 0").select("row.*")
