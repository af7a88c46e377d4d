"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Targets: the sources in code point order, null last, get the weights 3, 1, 2,
repeating; together they share ``share`` of all words. A target stops at ``most``
times its source's size, and the excess is shared again by weight until none is
above.

Choice: every document has a 60-bit hash of its id. A source takes whole copies
of all its documents while its target allows, and of the rest those whose hash
is below a threshold. The threshold comes from histograms: words summed by
source and hash bucket (12 bits), the bucket in which the running sum passes the
budget, then the same inside that bucket alone, five levels deep. No document is
sorted, and a histogram has at most 4,096 buckets for each source. Documents
with the hash at the threshold itself (one, or rows that repeat an id) give an
equal part of their words, counted from the front, so that each source takes its
target to within those rows' rounding.

Nulls, empty and odd input: a null text has size 0; a null source is a source of
its own; a null id hashes as one value; a source of size 0 has target 0; rows
that repeat an id are treated alike; an empty table gives an empty result; other
columns are kept or ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.shared import dropped, words, written

WEIGHTS = (3, 1, 2)
BITS, LEVELS = 12, 5


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(words(text))), F.lit(0)).cast("long")


def hash_of(doc_id: Column, seed: int = 0) -> Column:
    """60 bits, from the first 15 hexadecimal digits of an MD5."""
    name = F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row for each source, few enough for one task."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.select("source", "source_size", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).alias("w"))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    rising = weighed.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything)).alias("all"),
        F.sum("w").over(everything).alias("all_w"),
        F.sum("w").over(fill.rowsBetween(Window.unboundedPreceding, 0)).alias("w_to"),
        (F.lit(most) * F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, 0))).alias("cap_to"),
    )
    cap = F.lit(most) * F.col("source_size")
    left = F.col("all") - (F.col("cap_to") - cap)
    full = F.col("w") * left > cap * (F.col("all_w") - F.col("w_to") + F.col("w"))
    marked = rising.select("*", full.alias("full"))
    caps = F.coalesce(F.sum(F.when(F.col("full"), cap)).over(everything), F.lit(0))
    others = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    return marked.select(
        "source", "source_size", F.when(F.col("full"), cap.cast("double")).otherwise(F.col("w") * (F.col("all") - caps) / others).alias("target")
    )


def plan(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """From ``source, size, hash``: for each source ``source_size, target, copies``, the hash at its
    threshold (``at``), and the words that rows with that hash have (``at_size``) and give (``at_gives``)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    state = targets(totals, share, most).withColumn("copies", F.when(F.col("source_size") > 0, F.call_function("div", budget, F.col("source_size"))).otherwise(F.lit(0).cast("long")))
    base = written(state.withColumn("left", budget - F.col("copies") * F.col("source_size")), "mixing-plan")
    now = base.select("source", "left", F.lit(0).cast("long").alias("at"))
    bucket_order = Window.partitionBy("source").orderBy("bucket")
    for level in range(1, LEVELS + 1):
        wide, narrow = BITS * (LEVELS - level + 1), BITS * (LEVELS - level)
        inside = sizes.where("size > 0").select(F.col("source").alias("s"), "size", F.shiftright("hash", wide).alias("p"), F.shiftright("hash", narrow).alias("bucket"))
        held = inside.join(now, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("at")), "inner")
        counted = held.groupBy("source", "left", "bucket").agg(F.sum("size").alias("n"))
        running = counted.withColumn("to", F.sum("n").over(bucket_order)).where("to > left").groupBy("source").agg(F.min(F.struct("bucket", "to", "n", "left")).alias("x"))
        step = running.select("source", (F.col("x.left") - F.col("x.to") + F.col("x.n")).alias("left"), F.col("x.bucket").alias("at"), F.col("x.n").alias("n"))
        last, now = now, written(step, "mixing-level")
        if level > 1:
            dropped(last)
    found = now.select(F.col("source").alias("s"), "at", F.col("n").alias("at_size"), F.col("left").alias("at_gives"))
    return written(base.join(found, base.source.eqNullSafe(found.s), "left").drop("s", "left"), "mixing-plan")


def words_taken(size: Column, hashed: Column) -> tuple[Column, Column]:
    """Whole copies, and words from the front of one more, from a row's size and hash and its source's plan."""
    below = F.coalesce(hashed < F.col("at"), F.lit(False))
    part = F.when(hashed == F.col("at"), F.call_function("div", size * F.col("at_gives"), F.col("at_size")))
    return F.col("copies") + below.cast("long"), F.coalesce(part, F.lit(0).cast("long"))


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col, size, source_size, target, taken, copies, extra_words`` of every row."""
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col), seed).alias("hash")), "mixing")
    of_source = plan(sizes, share, most).withColumnRenamed("source", "s")
    copies, extra = words_taken(F.col("size"), F.col("hash"))
    both = sizes.join(of_source, F.col("source").eqNullSafe(F.col("s"))).select("*", copies.alias("whole"), extra.alias("extra_words"))
    return both.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra_words")).alias("taken"), F.col("whole").alias("copies"), "extra_words")


def mixed_documents(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, and those at the threshold cut after their last word taken."""
    marked = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), hash_of(F.col(id_col), seed).alias("hash"))
    of_source = plan(written(marked.select("source", size_of(F.col("text")).alias("size"), "hash"), "mixing"), share, most).withColumnRenamed("source", "s")
    copies, extra = words_taken(size_of(F.col("text")), F.col("hash"))
    both = marked.join(of_source, F.col("source").eqNullSafe(F.col("s"))).select("row", "text", copies.alias("whole"), extra.alias("extra"))
    blank = r"\x20\x09-\x0D"
    front = F.array_join(F.slice(F.split("text", f"(?<=[^{blank}])(?=[{blank}])"), F.lit(1), F.col("extra").cast("int")), "")
    copy = F.array_repeat(F.lit(None).cast("string"), F.col("whole").cast("int"))
    every = both.select("row", "text", F.explode(F.concat(F.transform(copy, lambda _: F.lit(False)), F.when(F.col("extra") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))).alias("cut"), "extra")
    out = every.select("row", F.when(F.col("cut"), front).otherwise(F.col("text")).alias("new_text"))
    return out.select(*(F.col("new_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
