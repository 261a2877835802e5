"""CSV files with line breaks inside quoted fields, read in many tasks.

Spark's ``multiLine`` option gives a whole file to one task, because whether a line break
ends a record depends on all quotes before it. Here lines are read as plain text, in
splits, and the quote state is carried by a prefix scan:

1. A line maps the state before it (outside or inside quotes) to the state after it. Such
   a map either forgets the state before, keeps it, or turns it over; the maps of
   consecutive lines compose to one of the same kind, so a split of a file is one small row.
2. The state at the start of a split follows from the maps of the splits before it (a
   window over a file's splits, one row each). These rows are broadcast to the lines.
3. A line that starts outside quotes starts a record. A task holds a split's lines in file
   order, so it cuts them into records as they stream by. No line is shuffled, but for the
   pieces of records that begin or end in another split: two to a split, grouped. They are
   noted in step 1, for either state at the split's start; splits with pieces longer than
   ``KEPT_CHARS`` are read again for them.
4. All records are then parsed by ``from_csv``.

Step 1 and step 3 each read the files once.

A quote opens a field only at the field's start and is doubled inside, as Spark's reader
has it. Lines end in LF or CRLF, and a CRLF inside a field becomes LF. A quote that is never closed makes one record of the
rest of its file, as with ``multiLine``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlens.session import stored
from ledgerlens.sources.raw_csv import RAW_SCHEMA

# longest piece of a record noted with its split
KEPT_CHARS = 1 << 16

# for RE2 (Arrow): linear in the line; a closing quote is one that no quote follows
_QUOTED_REST = r'[^"]*(?:""[^"]*)*"(?:[^",][^,]*)?'
_FIELD = rf'(?:"{_QUOTED_REST}|[^",][^,]*)?'
# a whole line that ends outside quotes, begun outside or inside
_ENDS_FROM_OUTSIDE = rf"^{_FIELD}(?:,{_FIELD})*$"
_ENDS_FROM_INSIDE = rf"^{_QUOTED_REST}(?:,{_FIELD})*$"


def _state(forgot: Column, turns: Column, start: Column | int) -> Column:
    """The state after lines of which the last that forgets left ``forgot`` (less the turns up
    to it, null if none), with ``turns`` in all, begun in ``start``."""
    return F.coalesce(forgot, F.lit(start) if isinstance(start, int) else start).bitwiseXOR(
        F.pmod(turns, F.lit(2)).cast("int"))


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, block, line) of every line; a task has a split's lines in file order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.decode(F.col("value").cast("binary"), encoding).alias("line"))


def _cutters(kept: int):
    """``maps`` and ``cut``, for ``mapInArrow``: nested, so that they travel to the executors
    whole and nothing of this package has to be installed there. ``maps`` notes pieces of up
    to ``kept`` characters."""
    def runs(*keys: pa.Array) -> Iterator[tuple[int, int]]:
        """(from, to) of the neighbouring rows that are equal in ``keys``."""
        n = len(keys[0])
        new = np.zeros(max(n - 1, 0), dtype=bool)
        for k in keys:
            new |= pc.not_equal(k.slice(1), k.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        return ((lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo)

    def states(line: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The states after each line, begun outside and inside quotes."""
        return tuple(1 - pc.match_substring_regex(line, ends).to_numpy(zero_copy_only=False).astype(int)
                     for ends in (_ENDS_FROM_OUTSIDE, _ENDS_FROM_INSIDE))

    def begun(after: np.ndarray, start: int) -> np.ndarray:
        """The places of the lines that start a record."""
        return np.flatnonzero(np.concatenate(([start], after[:-1])) == 0)

    def after_all(a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
        """The state after each of the lines with the maps ``a``, ``b``, begun in ``start``."""
        turns = np.cumsum((a == 1) & (b == 0)) % 2
        last = np.maximum.accumulate(np.where(a == b, np.arange(len(a)), -1))
        base = np.where(last >= 0, a[last] ^ turns[last], start)
        return base ^ turns

    def longer(piece: list | None, lines: pa.Array) -> list | None:
        """``piece`` and ``lines``, null once they are too long to be noted."""
        if piece is None or lines.nbytes > 4 * kept:
            return None
        more = piece + lines.to_pylist()
        return more if sum(map(len, more)) + len(more) <= kept else None

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each split. Its composed map: the state it ends in if it forgets the one
        before, else whether it turns that over. By the state it starts in, its pieces: ``head``,
        the lines before the first record, and ``tail``, the last record, null where there is
        none or (not ``kept``) where they are too long; ``first`` if that is the file's first."""
        at, ends = None, []
        piece = pa.struct([("head", pa.string()), ("tail", pa.string()), ("first", pa.bool_()), ("kept", pa.bool_())])

        def out() -> pa.RecordBatch:
            x, y = (e["state"] for e in ends)
            row = [*at, x if x == y else None, int(x != y and x == 1), [
                {"head": "\n".join(e["head"]) if e["head"] else None, "tail": "\n".join(e["tail"]) if e["tail"] else None,
                 "first": at[1] == 0 and e["n"] == 1, "kept": e["head"] is not None and e["tail"] is not None} for e in ends]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                row, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(piece)))],
                ["file", "block", "forgets", "turns", "ends"])

        for batch in batches:
            file, block, line = batch.columns
            a, b = states(line)
            for lo, hi in runs(file, block):
                key = (file[lo].as_py(), block[lo].as_py())
                if key != at:
                    if at:
                        yield out()
                    at, ends = key, [{"state": s, "n": 0, "head": [], "tail": []} for s in (0, 1)]
                lines = line.slice(lo, hi - lo)
                for e in ends:
                    after = after_all(a[lo:hi], b[lo:hi], e["state"])
                    begins = begun(after, e["state"])
                    e["state"] = int(after[-1])
                    if not e["n"]:
                        e["head"] = longer(e["head"], lines.slice(0, begins[0] if len(begins) else hi - lo))
                    if len(begins):
                        e["tail"] = longer([], lines.slice(begins[-1]))
                    elif e["n"]:
                        e["tail"] = longer(e["tail"], lines)
                    e["n"] += len(begins)
        if at:
            yield out()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines cut into records. ``head`` is null for a whole record, true for the end of one
        begun in an earlier split, false for a split's last one, which may go on in the next."""
        at, piece, head, first, state = None, [], True, False, 0

        def out(records: pa.Array, head: bool | None, first: bool) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * n, pa.int32()), pa.array([at[1]] * n, pa.int64()), pa.array([head] * n, pa.bool_()),
                 pa.array([first, *[False] * (n - 1)], pa.bool_()), records], ["fno", "block", "head", "first", "record"])

        def joined() -> pa.Array:
            return pa.array(["\n".join(piece)], pa.string())

        for batch in batches:
            fno, block, start, line = batch.columns
            a, b = states(line)
            for lo, hi in runs(fno, block):
                key = (fno[lo].as_py(), block[lo].as_py())
                fresh = key != at
                if fresh:
                    if piece:
                        yield out(joined(), head, first)
                    at, piece, head, first, state = key, [], True, False, start[lo].as_py()
                after = after_all(a[lo:hi], b[lo:hi], state)
                begins = begun(after, state)
                state, lines = int(after[-1]), line.slice(lo, hi - lo)
                piece += lines.slice(0, begins[0] if len(begins) else hi - lo).to_pylist()
                if not len(begins):
                    continue
                if piece:
                    yield out(joined(), True if head else None, first)
                opens_file = fresh and key[1] == 0
                if len(begins) > 1:
                    lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), lines)
                    yield out(pc.binary_join(lists, "\n"), None, opens_file)
                piece, head = lines.slice(begins[-1]).to_pylist(), False
                first = opens_file and len(begins) == 1
        if piece:
            yield out(joined(), head, first)

    return maps, cut


def _scanned(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds, over the rows before each in its ``keys``: ``_turns`` and ``_forgot``."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = lines.withColumn("_upto", F.sum("turns").over(upto))
    base = F.col("forgets").bitwiseXOR(F.pmod("_upto", F.lit(2)).cast("int"))
    return summed.withColumn("_base", base).withColumns({
        "_turns": F.coalesce(F.sum("turns").over(before), F.lit(0)),
        "_forgot": F.last("_base", ignorenulls=True).over(before)})


def records(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(first, record): the records of the files at ``path``, line breaks inside quotes
    kept; ``first`` marks a file's first one. Blank lines between records are left out."""
    maps, cutter = _cutters(KEPT_CHARS)
    lines = _lines(spark, path, encoding)
    # one row per split
    whole = lines.mapInArrow(maps, "file string, block long, forgets int, turns int, "
                             "ends array<struct<head: string, tail: string, first: boolean, kept: boolean>>")
    started = _scanned(whole, ["file"], "block").withColumn("start", _state(F.col("_forgot"), F.col("_turns"), 0))
    splits = stored(started.select("file", "block", "start", F.get("ends", F.col("start")).alias("end")).select(
        "file", "block", F.dense_rank().over(Window.orderBy("file")).alias("fno"), "start", "end.*"))

    def cut(some: DataFrame) -> DataFrame:
        placed = lines.join(F.broadcast(some.select("file", "block", "fno", "start")), ["file", "block"])
        return placed.select("fno", "block", "start", "line").mapInArrow(
            cutter, "fno int, block long, head boolean, first boolean, record string")

    single = cut(splits).where("head is null").select("first", "record")
    noted = [splits.where("kept").select("fno", "block", F.lit(at == "head").alias("head"), (
        F.col("first") & (at == "tail")).alias("first"), F.col(at).alias("record")) for at in ("head", "tail")]
    pieces = noted[0].unionByName(noted[1]).where("record is not null")
    long = splits.where("not kept")
    if not long.isEmpty():
        pieces = pieces.unionByName(cut(long).where("head is not null"))
    # a split's first lines belong to the last record begun before
    upto = Window.partitionBy("fno").orderBy("block", ~F.col("head")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(~F.col("head"), F.col("block")), ignorenulls=True).over(upto)
    several = stored(pieces.withColumn("_owner", owner).groupBy("fno", "_owner").agg(
        F.max("first").alias("first"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("block", "record"))), lambda s: s["record"]), "\n").alias("record")))
    # line ends inside a field come out as LF, as Spark's reader gives them in CRLF files
    text = F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    out = single.unionByName(several.select("first", "record")).select("first", text.alias("record"))
    return out.where((F.trim("record") != "") | F.col("first"))


def write_crlf_export(df: DataFrame, path: str, columns: list[str], bad_row: Column | None = None) -> None:
    """``df`` in the raw layout with CRLF line ends, every text quoted, line breaks and quotes
    kept. After a row where ``bad_row`` holds, a broken row of three fields follows. Compressed
    by bzip2, the codec whose files are still read in splits."""
    def text(name: str) -> Column:
        if name not in df.columns:
            return F.lit("")
        value = F.col(name)
        if isinstance(df.schema[name].dataType, StringType):
            value = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(value.cast("string"), F.lit(""))

    line = F.concat(F.concat_ws(",", *[text(c) for c in columns]), F.lit("\r"))
    broken = F.when(bad_row, F.lit("torn,row,of three\r")) if bad_row is not None else F.lit(None).cast("string")
    rows = df.select(F.explode(F.array(line, broken)).alias("line")).where("line is not null")
    rows.write.option("compression", "bzip2").text(path)


def read_split_csv(spark: SparkSession, path: str, schema: StructType = RAW_SCHEMA, encoding: str = "ISO-8859-1",
                   bad_rows: str | None = None, header: bool = True) -> DataFrame:
    """The rows of ``path`` under an all-text ``schema``, the same as with ``multiLine`` but in as
    many tasks as the files have splits. ``bad_rows`` names a column with the text of rows
    that do not have the schema's number of fields."""
    extra = [StructField(bad_rows, StringType(), True)] if bad_rows else []
    wanted = StructType([*schema.fields, *extra])
    rows = records(spark, path, encoding)
    if header:
        rows = rows.where(~F.col("first"))
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    if bad_rows:
        options["columnNameOfCorruptRecord"] = bad_rows
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.fields)
    return rows.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
