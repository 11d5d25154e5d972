"""Ordered and relational building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.staging import discard, staged


def dense_line_id(df: DataFrame, order: list[str], name: str = "LineId") -> DataFrame:
    """``df`` with 1..n in the order of ``order``, without bringing all rows to one task.

    Keys must be unique and not null. Rows are range-partitioned and sorted once, and
    stored with their partition and place, so that counting and numbering see the same
    partitions whatever adaptive planning makes of them and whatever executor is lost.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return _numbered(staged(_placed(ranged, F.spark_partition_id()), "lines"), ["_part"], df.columns, name)


def dense_line_id_in_files(df: DataFrame, file: str, block: str, name: str = "LineId") -> DataFrame:
    """1..n over rows as scanned from files: by file, then by the offset of the split, then by place in the split.

    ``file`` and ``block`` are the scan's ``file_path`` and ``file_block_start``. A split is read
    by one task from its beginning to its end, so nothing is shuffled or sorted.
    """
    return _numbered(staged(_placed(df), "lines"), [file, block], df.columns, name)


def _placed(df: DataFrame, *part: Column) -> DataFrame:
    """``df`` with each row's running number in its task (``_place``), and ``_part`` if given."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.select("*", *(p.alias("_part") for p in part), place.alias("_place"))


def _numbered(stored: DataFrame, parts: list[str], columns: list[str], name: str) -> DataFrame:
    """Stored rows numbered by ``parts`` and, inside, by ``_place``; a part's rows have places without gaps."""
    # One row a partition or split.
    sizes = stored.groupBy(*parts).agg(F.count("*").alias("_rows"), F.min("_place").alias("_least"))
    before = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_least") + 1
    offsets = sizes.select(*parts, offset.alias("_offset"))
    return stored.join(offsets, parts).select((F.col("_offset") + F.col("_place")).alias(name), *columns)


def prefix_sample(df: DataFrame, rate: float, line: str = "LineId") -> DataFrame:
    """The lines whose 0-based place is at most ``rate`` of all."""
    total = df.select(F.count("*").alias("_total"))
    return df.crossJoin(F.broadcast(total)).where((F.col(line) - 1) / F.col("_total") <= rate).drop("_total")  # one row


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows of least seeded hash (md5 of seed, colon and key): a sample without replacement that repeats."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(hashed, key).limit(n)


def last_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and the value of its last row."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str | None) -> DataFrame:
    """``df`` with ``value`` looked up in a table of unique keys."""
    found = df.join(table.select(key, value), key, "left")
    return found if default is None else found.withColumn(value, F.coalesce(value, F.lit(default)))


def renumber(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` (a template dimension) with ``name``, the 0-based rank of ``key``."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(key)) - 1)


def neighbourhood(a: DataFrame, b: DataFrame, place: str, reach: int) -> DataFrame:
    """Rows of ``a`` beside rows of ``b`` (columns with a leading ``n_``) at most ``reach`` places away, not themselves.

    A band join as an equi-join: ``b`` is copied to the three blocks of ``reach``
    places that it can be near to.
    """
    block: Column = F.floor(F.col(place) / reach)
    near = b.select(*(F.col(c).alias(f"n_{c}") for c in b.columns), F.explode(F.array(block - 1, block, block + 1)).alias("_block"))
    pairs = a.withColumn("_block", block).join(near, "_block").drop("_block")
    return pairs.where((F.abs(F.col(place) - F.col(f"n_{place}")) <= reach) & (F.col(place) != F.col(f"n_{place}")))


def roots(links: DataFrame, node: str = "cid", to: str = "next") -> DataFrame:
    """(cid, root): each id's last redirect, found by doubling the links until nothing moves.

    Redirects form chains that end at an id pointing to itself. Each step is stored, and
    the one before it deleted.
    """
    now = links.select(F.col(node).alias("cid"), F.col(to).alias("root"))
    while True:
        further = now.select(F.col("cid").alias("root"), F.col("root").alias("_further"))
        after = F.coalesce("_further", "root")
        moved = now.join(further, "root", "left").select("cid", after.alias("root"), (after != F.col("root")).alias("_moved"))
        moved = staged(moved, "roots")
        discard(now)
        now = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return now
        now._staged_path = moved._staged_path  # noqa: SLF001
