"""Line dedup by content-defined chunks of lines.

Native DataFrame operations only. Each line has a hash; a hash rolled over a line and the
one before it hits by its lowest bit. A chunk begins at the first of neighbouring hits, so it
has two lines at least (the first and the last line of a text stay with their
neighbours), and inserted lines shift no boundary but the nearest. A line of ``LONG`` words or
more is a chunk of its own and counts as several lines; other chunks take part from two lines on.

1. Chunks are grouped by hash over all documents, without their text.
2. Documents are joined with their chunks whose hash occurs again. The bytes of every
   hash group are compared through its least and greatest text, which partial
   aggregation computes without bringing a group to one task. Groups that differ (a
   collision) are dealt by hash and text.
3. All occurrences but the first, by doc_id and position, are cut from the texts.

Defined cases: a null text stays null, with null counts, and an empty one empty; rows with the same
doc_id and text count as one and are treated alike; a null doc_id comes before all
others; a text may become empty; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import staged

#: Words from which a line is a chunk of its own.
LONG = 50


def line_hash(line: Column) -> Column:
    """32 bits of a line."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _shift(values: Column, first: Column) -> Column:
    """An array with ``first`` put before it and its last element dropped."""
    return F.concat(F.array(first), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))))


def with_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``chunks``: the texts of the chunks, where a space follows each inner line feed.

    Every line gets a mark, ``!`` where a chunk begins and a space elsewhere; then a
    line feed and ``!`` part the chunks, whatever the lines hold.
    """
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    none = F.struct(F.lit(0).cast("long").alias("h"), F.lit(False).alias("long"))
    lines = docs.withColumn("_lines", F.split(text, "\n", -1)).withColumn(
        "_facts", F.transform("_lines", lambda x: F.struct(line_hash(x).alias("h"), (words(x) >= LONG).alias("long")))
    )
    # The hash rolled over lines i-1 and i.
    rolled = F.zip_with(
        _shift(F.col("_facts"), none),
        "_facts",
        lambda a, b: F.struct(
            (F.shiftrightunsigned(a["h"], 1).bitwiseXOR(b["h"]).bitwiseAND(F.lit(1)) == 0).alias("hit"), (a["long"] | b["long"]).alias("long")
        ),
    )
    near = lines.withColumn("_rolled", rolled)
    before = _shift(F.transform("_rolled", lambda r: r["hit"]), F.lit(False))
    opens = F.zip_with("_rolled", before, lambda r, b: F.struct((r["hit"] & ~b).alias("first"), r["long"].alias("long")))
    inside = lambda i: (i >= 2) & (i < F.size("_lines") - 1)
    starts = F.transform(opens, lambda o, i: (i == 0) | o["long"] | (o["first"] & inside(i)))
    marked = F.zip_with(starts, "_lines", lambda s, x: F.concat(F.when(s, F.lit("!")).otherwise(F.lit(" ")), x))
    chunks = F.split(F.substr(F.array_join(marked, "\n"), F.lit(2)), "\n!", -1)
    return near.withColumn("chunks", F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(chunks)).drop("_lines", "_facts", "_rolled")


def _counts(chunk: Column) -> Column:
    """Whether a chunk has several lines, or a long one."""
    return F.contains(chunk, F.lit("\n")) | (F.length(chunk) - F.length(F.replace(chunk, F.lit(" "), F.lit(""))) + 1 >= LONG)


def _flags(places: Column) -> Column:
    """An array that is true at the given rising positions and ends with the last of them."""
    flags = F.flatten(
        F.zip_with(
            places,
            _shift(places, F.lit(-1)),
            lambda a, b: F.concat(F.array_repeat(F.lit(False), a - b - 1), F.array(F.lit(True))),
        )
    )
    return F.when(F.size(places) > 0, flags).otherwise(F.array().cast("array<boolean>"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, _text, pos, hash and first of every chunk whose hash occurs more than once."""
    # The outer form: before a plain one the optimiser puts a filter that computes the chunks again.
    found = with_chunks(_keyed(docs)).select("doc_id", "_text", F.posexplode_outer("chunks").alias("pos", "chunk"))
    found = found.where(_counts(F.col("chunk"))).select("doc_id", "_text", "pos", F.xxhash64("chunk").alias("hash"))
    found = staged(found, "line-chunks")
    place = F.struct("doc_id", "_text", "pos")
    groups = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    return found.join(groups, "hash").select(
        "doc_id", "_text", "pos", "hash", (F.col("first") == place).alias("is_first")
    )


def _joined(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """``docs`` left-joined by row key; a null doc_id meets itself."""
    right = per_doc.withColumnRenamed("doc_id", "_id").withColumnRenamed("_text", "_key")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_key"))
    return docs.join(right, on, "left").drop("_id", "_key")


def _apart(marked: DataFrame) -> DataFrame:
    """doc_id, _text, pos, hash and chunk of every candidate, taken from the stored documents."""
    rows = with_chunks(marked.where("found is not null"))
    at = F.transform("found", lambda f: f["pos"])
    wanted = F.zip_with("chunks", _flags(at), lambda c, f: F.when(f, c))
    wanted = F.filter(wanted, lambda c: c.isNotNull())
    zipped = F.zip_with(wanted, "found", lambda c, f: F.struct(f["pos"].alias("pos"), f["hash"].alias("hash"), c.alias("chunk")))
    return rows.select("doc_id", "_text", F.explode_outer(zipped).alias("c")).select("doc_id", "_text", "c.*").where("chunk is not null")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated chunks, n_lines before, removed_lines and removed_chunks of each row."""
    per_doc = (
        candidates(docs)
        .groupBy("doc_id", "_text")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "hash", "is_first"))).alias("found"))
    )
    marked = staged(_joined(_keyed(docs), per_doc), "line-docs")
    apart = _apart(marked)
    unequal = staged(
        apart.groupBy("hash").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("hash"), "line-collisions"
    )
    drop = F.filter("found", lambda f: ~f["is_first"])
    if not unequal.isEmpty():
        place = F.struct("doc_id", "_text", "pos")
        exact = apart.join(unequal, "hash")
        least = exact.groupBy("hash", "chunk").agg(F.min(place).alias("least"))
        again = exact.join(least, ["hash", "chunk"]).where(F.col("least") != place)
        again = again.groupBy("doc_id", "_text").agg(F.collect_set("pos").alias("again"))
        # Of the colliding hashes only what was found to be equal goes.
        solid = apart.join(unequal, "hash", "left_anti").groupBy("doc_id", "_text").agg(F.collect_set("pos").alias("solid"))
        marked = _joined(_joined(marked, again), solid)
        keep = F.coalesce("solid", F.array().cast("array<int>"))
        more = F.coalesce("again", F.array().cast("array<int>"))
        places = F.array_sort(F.array_union(F.array_intersect(F.transform(drop, lambda f: f["pos"]), keep), more))
    else:
        places = F.transform(drop, lambda f: f["pos"])
    rows = with_chunks(marked.withColumn("_places", F.coalesce(places, F.array().cast("array<int>"))))
    removed = F.zip_with("chunks", _flags(F.col("_places")), lambda c, f: F.when(F.coalesce(f, F.lit(False)), F.lit(None)).otherwise(c))
    kept = rows.withColumn("_kept", F.filter(removed, lambda c: c.isNotNull()))
    whole = F.replace(F.array_join("_kept", "\n "), F.lit("\n "), F.lit("\n"))
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1
    n_kept = F.when(F.size("_kept") == 0, 0).otherwise(lines(F.col("_new")))
    return (
        kept.withColumn("_new", F.when(F.size("_places") == 0, F.col("text")).otherwise(whole))
        .select(
            "doc_id",
            F.col("_new").alias("text"),
            lines(F.col("text")).alias("n_lines"),
            (lines(F.col("text")) - n_kept).alias("removed_lines"),
            F.when(F.col("text").isNotNull(), F.size("_places")).alias("removed_chunks"),
        )
    )
