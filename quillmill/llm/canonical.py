"""Problem 6: records that are the same but for white space, letter case, punctuation or field order.

Canonical records are range-partitioned and sorted by their whole key and id; one scan compares each record with
the one before it, key by key, and gives every member of a run the run's first id. A run that crosses partitions,
however many, is continued from a note of each partition's first and last key, one row a partition. The ranges
include the id, so a group that holds any share of all rows is spread over many tasks; no group is ever gathered.

Null agrees with null only; an empty value is not null. Ids must be unique; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.session import cut, partitions, written

NULL = "\0"
#: Bytes of canonical records, as stored, that make one range.
RANGE_BYTES = 64 << 20


def ranges(canon: DataFrame) -> int:
    """Number of ranges for stored records: by their size, and no fewer than the session's shuffle partitions."""
    spark = canon.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = canon.inputFiles()
    if not files:
        return 1
    folder = path(files[0]).getParent()
    size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return max(partitions(spark), -(-size // RANGE_BYTES))


def one_case(c: Column) -> Column:
    """Letter case folded; by way of upper case, so that the sharp s agrees with its capitals."""
    return F.lower(F.upper(c))


def letters_and_numbers(c: Column) -> Column:
    """Key of a field list: its words and numbers in any order; words of up to three letters (initials, also run together) by letter."""
    words = F.regexp_extract_all(one_case(c), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    numbers = F.regexp_extract_all(c, F.lit(r"\p{Nd}+"), F.lit(0))
    short = F.split(F.array_join(F.filter(words, lambda w: F.length(w) <= 3), ""), "")
    return F.concat_ws("|", F.array_join(F.array_sort(F.filter(words, lambda w: F.length(w) > 3)), " "), F.array_join(F.array_sort(short), ""), F.array_join(F.array_sort(numbers), " "))


def letters_and_digits(c: Column) -> Column:
    """Key of a title: its letters and digits in order."""
    return F.regexp_replace(one_case(c), r"[^\p{L}\p{M}\p{N}]+", "")


def identifier(c: Column) -> Column:
    """Key of a DOI: what follows the label or resolver address."""
    low = F.lower(c)
    found = F.regexp_extract(low, r"(10\s*\.\s*\d.*)", 1)
    return F.regexp_replace(F.when(found != "", found).otherwise(low), r"[^\p{L}\p{N}]+", "")


def canonical_runs(rows: DataFrame, id_col: str, keys: list[Column], n_parts: int | None = None) -> DataFrame:
    """``(first_id, id)`` of every row: the least id of the rows with equal keys, and the row's own."""
    names = [f"k{i}" for i in range(len(keys))]
    # Written, since the ranges are found by a first pass over the keys.
    canon = written(rows.select(F.col(id_col).cast("long").alias("id"), *[F.coalesce(k, F.lit(NULL)).alias(n) for k, n in zip(keys, names, strict=True)]))
    order = [F.xxhash64(*names), *names, "id"]
    ranged = canon.repartitionByRange(n_parts or ranges(canon), *order).sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last_key: list[str] | None = None
        first_key: list[str] | None = None
        first, run = 0, 0
        schema = pa.schema([("part", pa.int32()), ("lead", pa.bool_()), ("first_id", pa.int64()), ("id", pa.int64()), ("head", pa.list_(pa.string())), ("tail", pa.list_(pa.string()))])
        for b in batches:
            if not b.num_rows:
                continue
            n, ids = b.num_rows, b.column(0).to_pylist()
            cols = [b.column(i + 1) for i in range(len(names))]
            same = [False] + ([True] * (n - 1))
            if n > 1:
                eq = pc.equal(cols[0].slice(1), cols[0].slice(0, n - 1))
                for c in cols[1:]:
                    eq = pc.and_(eq, pc.equal(c.slice(1), c.slice(0, n - 1)))
                same[1:] = eq.to_pylist()
            head = [c[0].as_py() for c in cols]
            same[0] = head == last_key
            first_key = first_key or head
            firsts, lead = [], []
            for k in range(n):
                if not same[k]:
                    first, run = ids[k], run + 1
                firsts.append(first)
                lead.append(run == 1)
            last_key = [c[n - 1].as_py() for c in cols]
            none = pa.nulls(n, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(lead), pa.array(firsts, pa.int64()), b.column(0), none, none], schema=schema)
        if first_key is not None:
            # The note: in "lead", whether one run fills the partition; in "first_id", the last run's first id.
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run == 1]), pa.array([first], pa.int64()), pa.array([None], pa.int64()), pa.array([first_key], pa.list_(pa.string())), pa.array([last_key], pa.list_(pa.string()))], schema=schema)

    scanned = cut(ranged.mapInArrow(scan, "part int, lead boolean, first_id bigint, id bigint, head array<string>, tail array<string>"))
    # One row a partition: bounded by the number of partitions, not by the data.
    notes = sorted(scanned.filter("id IS NULL").collect(), key=lambda r: r.part)
    carried: list[tuple[int, int]] = []
    tail, open_id = None, 0
    for r in notes:
        goes_on = tail == list(r.head)
        if goes_on:
            carried.append((r.part, open_id))
        if not (goes_on and r.lead):
            open_id = r.first_id
        tail = list(r.tail)
    out = scanned.filter("id IS NOT NULL")
    if carried:
        whole = F.create_map(*[F.lit(x) for pair in carried for x in pair])
        out = out.withColumn("first_id", F.when(F.col("lead"), F.coalesce(F.element_at(whole, F.col("part")), F.col("first_id"))).otherwise(F.col("first_id")))
    return out.select("first_id", "id")


def reference_keys() -> list[Column]:
    """Keys of extracted references: raw, title, doi."""
    return [letters_and_numbers(F.col("raw")), letters_and_digits(F.col("title")), identifier(F.col("doi"))]


def collapse(runs: DataFrame) -> DataFrame:
    """``(first_id, copies)``: one row a record with its exact number of copies; counted before the shuffle."""
    return runs.groupBy("first_id").agg(F.count("*").alias("copies"))


__all__ = ["canonical_runs", "collapse", "identifier", "letters_and_digits", "letters_and_numbers", "one_case", "reference_keys"]
