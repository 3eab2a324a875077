"""Records of CSV files with line breaks in quotes, read by many tasks.

A line is a map of two states: whether the next line starts inside quotes, if this one starts outside and if it starts
inside. Maps are composed along the lines of a split as they are read, then along the splits of a file, one row each, and tell
of every line whether it starts a record. Lines of one record are put together, all others are records as they stand.
No task sorts or holds the lines of a split.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import stage

#: Fields of a record by what the engine's reader takes for one. Quotes inside quotes are doubled; after a closing quote
#: and in a field that does not begin with one, everything up to the separator belongs to the field.
BODY = '[^"]*+(?:""[^"]*+)*+'


def patterns(sep: str) -> tuple[str, str]:
    """Patterns of the lines after which quotes are open, for lines that start outside and inside of quotes."""
    s = re.escape(sep)
    field = f'(?:"{BODY}"[^{s}]*+|[^"{s}][^{s}]*+|)'
    rest = f'(?:{field}{s})*+"{BODY}\\z'
    return f"(?s)^{rest}", f'(?s)^{BODY}(?:\\z|"[^{s}]*+{s}{rest})'


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, place, line`` of all lines; a carriage return at the end stays."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )


def breaks_in_quotes(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether any line leaves quotes open; if none does, every line is a record."""
    return bool(spark.read.option("lineSep", "\n").text(path).where(F.col("value").contains('"') & F.col("value").rlike(patterns(sep)[0])).take(1))


def open_after(maps: DataFrame, by: list[str], along: str) -> DataFrame:
    """Adds ``end_out`` and ``end_in``: the state after each row, in the order of ``along``, for both states before the first row.

    A map with one result for both states forgets what was before it; since the last such row the others only keep or
    change the state, so that counts of changes give it.
    """
    order = Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed, change = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    counted = maps.withColumn("__since", F.sum(fixed.cast("int")).over(order)).withColumn("__changes", F.sum(change.cast("int")).over(order))
    inner = Window.partitionBy(*by, "__since").orderBy(along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lambda c: F.first(c).over(inner)
    odd = (F.col("__changes") - first(F.col("__changes") - change.cast("int"))) % 2 == 1
    known = F.col("__since") > 0
    base = first(F.col("from_out"))
    told = lambda start: F.when(known, base != odd).otherwise(F.lit(start) != odd)
    return counted.withColumns({"end_out": told(False), "end_in": told(True)}).drop("__since", "__changes")


def along_lines(lines: DataFrame) -> DataFrame:
    """Adds, for both states before a split: the state before and after each line, and how many records began up to it.

    A task reads the lines of a split in their order, so that two states and two counts are all it keeps of those before;
    a batch of lines is handled at once, and its lines are not looked at in Python.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        here, state, number = None, [False, True], [0, 0]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = [batch.column("file").dictionary_encode(), batch.column("split").to_numpy(zero_copy_only=False)]
            file = names[0].indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((file[1:] != file[:-1]) | (names[1][1:] != names[1][:-1])) + 1
            maps = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("from_out", "from_in")]
            out = {c: np.zeros(n, t) for c, t in (("before_out", bool), ("before_in", bool), ("end_out", bool), ("end_in", bool), ("number_out", np.int64), ("number_in", np.int64))}
            for a, b in zip([0, *cuts], [*cuts, n]):
                own = (batch.column("file")[a].as_py(), int(names[1][a]))
                if own != here:
                    here, state, number = own, [False, True], [0, 0]
                of_out, of_in = maps[0][a:b], maps[1][a:b]
                # The last line that has one result for both states tells it; since then the state was only kept or changed.
                fixed = np.maximum.accumulate(np.where(of_out == of_in, np.arange(b - a), -1))
                changes = np.cumsum(of_out & ~of_in)
                base = np.where(fixed >= 0, changes[fixed], 0)
                odd = (changes - base) % 2 == 1
                for k, side in enumerate(("out", "in")):
                    end = np.where(fixed >= 0, of_out[fixed], state[k]) != odd
                    before = np.concatenate([[state[k]], end[:-1]])
                    begun = number[k] + np.cumsum(~before)
                    out[f"before_{side}"][a:b], out[f"end_{side}"][a:b], out[f"number_{side}"][a:b] = before, end, begun
                    state[k], number[k] = bool(end[-1]), int(begun[-1])
            kept = ["file", "split", "place", "line"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, out.values())], [*kept, *out])

    return lines.mapInArrow(
        run, "file string, split long, place long, line string, before_out boolean, before_in boolean, end_out boolean, end_in boolean, "
        "number_out long, number_in long"
    )


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``record`` of every row of the files but their headers: all lines of the row, with the line breaks between them.

    A record is held by one task, as it is one row. Lines of blanks outside of quotes are none. A quote that is never
    closed takes in the rest of its file, as it does for a reader of whole files.
    """
    out, inside = patterns(sep)
    maps = lines_of(spark, path).withColumns({"from_out": F.col("line").rlike(out), "from_in": F.col("line").rlike(inside)})
    lines = stage(along_lines(maps), "csv-lines")
    last = lines.groupBy("file", "split").agg(F.max_by(F.struct("end_out", "end_in", "number_out", "number_in"), "place").alias("m"))
    last = stage(last.select("file", "split", "m.*"), "csv-ends")
    splits = open_after(last.select("file", "split", F.col("end_out").alias("from_out"), F.col("end_in").alias("from_in")), ["file"], "split")
    by_split = Window.partitionBy("file").orderBy("split")
    splits = splits.select("file", "split", F.coalesce(F.lag("end_out").over(by_split), F.lit(False)).alias("opened"))
    # A line of no record of its split belongs to the last record that began in a split before it.
    counted = last.join(splits, ["file", "split"]).select("file", "split", "opened", F.when(F.col("opened"), F.col("number_in")).otherwise(F.col("number_out")).alias("last"))
    begun = F.last(F.when(F.col("last") > 0, F.struct("split", "last")), ignorenulls=True).over(by_split.rowsBetween(Window.unboundedPreceding, -1))
    owners = counted.withColumn("owner", begun).select("file", "split", "opened", F.col("owner.split").alias("own_split"), F.col("owner.last").alias("own_number"))
    owners = F.broadcast(stage(owners, "csv-splits"))  # a row a split
    told = lambda c: F.when(F.col("opened"), F.col(f"{c}_in")).otherwise(F.col(f"{c}_out")).alias(c)
    starts = lines.join(owners, ["file", "split"]).select("file", "split", "place", "line", "own_split", "own_number", told("before"), told("end"), told("number"))
    alone = starts.where(~F.col("before") & ~F.col("end")).select("file", "split", "number", "line")
    parts = starts.where(F.col("before") | F.col("end"))
    key = [F.when(F.col("number") > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("split", "own_split"), ("number", "own_number"))]
    joined = parts.select("file", key[0].alias("split"), key[1].alias("number"), F.struct(F.col("split").alias("at"), "place", "line").alias("part"))
    joined = joined.groupBy("file", "split", "number").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = joined.select("file", "split", "number", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line"))
    every = alone.unionByName(whole).where(F.trim(F.regexp_replace("line", "[\r\t\f]", "")) != "")
    first = every.groupBy("file").agg(F.min(F.struct("split", "number")).alias("header"))
    rows = every.join(F.broadcast(first), "file").where(F.struct("split", "number") != F.col("header"))
    return rows.select(F.regexp_replace("line", "\r$", "").alias("record"))


def parsed(rows: DataFrame, schema, options: dict[str, str]) -> DataFrame:
    """Columns of ``schema`` from each ``record``."""
    listed = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return rows.select(F.from_csv("record", listed, options).alias("r")).select("r.*")
