"""Text files read by several tasks: numbers of lines, and JSON arrays cut into records.

A task reads a byte range of a file and does not know what comes before.  What a range
contributes is summed up once per range, a window over the few ranges of a file adds that up,
and every range then knows where it starts: the number of its first line, or, for JSON,
whether it starts in a string and how deep in brackets.

With ``parts`` the files of a folder are one text, put together in the order of their names;
so several tasks can also write it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.session import ship_package

_PLACE = ["file", "start"]


def _whole(path: str, parts: bool) -> Column:
    """What a range belongs to: its file, or with ``parts`` all files of the path."""
    return F.lit(path) if parts else F.col("file")


def _pieces(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``(value, file, start)``: what lies between separators, with the range it was read in.

    Within a range rows keep the order of the file.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def read_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """``(file, line, value)``: all lines, blank ones too, numbered from 1 in each file, or
    with ``parts`` through all files.

    Lines of a range are consecutive in the task that reads it, so a line's number is that of
    the range's first line plus its distance from it.  Only counts are exchanged.
    """
    lines = _pieces(spark, path).withColumn("_id", F.monotonically_increasing_id())
    ranges = lines.groupBy(*_PLACE).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(_whole(path, parts)).orderBy(*_PLACE)) - F.col("_n")
    known = ranges.select(*_PLACE, before.alias("_before"), "_first")
    # A row for each range of a file: as many as there are tasks.
    return lines.join(F.broadcast(known), _PLACE).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value"
    )


# --- JSON arrays ------------------------------------------------------------------

#: Records are objects, so pieces end where an object may.
_END = "}"
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def _scan(piece: str, in_string: bool) -> tuple[bool, int]:
    """Whether the piece ends within a string, and by how much it goes deeper without its end."""
    if in_string:
        rest = _REST_OF_STRING.match(piece)
        if rest is None:
            return True, 0
        piece = piece[rest.end() :]
    bare = _STRING.sub("", piece)
    at = bare.find('"')
    opened = bare[:at] if at >= 0 else bare
    return at >= 0, opened.count("{") + opened.count("[") - opened.count("]")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: for a start outside and inside a string, how it ends and how deep."""
    sums: dict[tuple, list] = {}
    for batch in batches:
        for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", *_PLACE)), strict=True):
            # [inside at the end, depth] for a start outside, then for one inside.
            states = sums.setdefault((file, start), [[False, 0], [True, 0]])
            for state in states:
                state[0], deeper = _scan(value, state[0])
                state[1] += deeper - (not state[0])
    rows = [(*k, outside[0], outside[1], inside[0], inside[1]) for k, (outside, inside) in sums.items()]
    names = [*_PLACE, "out_ends", "out_deeper", "in_ends", "in_deeper"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_SUMS = "file string, start long, out_ends boolean, out_deeper long, in_ends boolean, in_deeper long"


def _starts(sums: DataFrame, whole: Column) -> DataFrame:
    """``(file, start, in_string, depth, last, sound)``: how each range starts, in one fold for
    each ``whole`` over its ranges; ``sound`` tells whether it ends outside of everything."""

    def step(acc, r):
        inside = acc["inside"]
        # What follows the last bracket of a file is counted as if it ended in one.
        begins = acc["depth"] + F.when(acc["file"] != r["file"], F.lit(1)).otherwise(F.lit(0))
        ends = F.when(inside, r["in_ends"]).otherwise(r["out_ends"])
        depth = begins + F.when(inside, r["in_deeper"]).otherwise(r["out_deeper"])
        row = F.struct(
            r["file"].alias("file"), r["start"].alias("start"), inside.alias("in_string"), begins.alias("depth")
        )
        return F.struct(
            r["file"].alias("file"), ends.alias("inside"), depth.alias("depth"),
            F.concat(acc["rows"], F.array(row)).alias("rows"),
        )

    ranges = F.sort_array(F.collect_list(F.struct(*_PLACE, "out_ends", "out_deeper", "in_ends", "in_deeper")))
    none = F.array().cast("array<struct<file: string, start: bigint, in_string: boolean, depth: bigint>>")
    first = F.struct(
        F.lit(None).cast("string").alias("file"), F.lit(False).alias("inside"),
        F.lit(0).cast("long").alias("depth"), none.alias("rows"),
    )
    texts = sums.groupBy(whole.alias("whole")).agg(ranges.alias("r")).select(F.aggregate("r", first, step).alias("s"))
    sound = ~F.col("s.inside") & (F.col("s.depth") == -1)
    final = F.element_at("s.rows", -1)
    return texts.select(sound.alias("sound"), final.alias("final"), F.inline("s.rows")).select(
        *_PLACE, "in_string", "depth",
        ((F.col("file") == F.col("final.file")) & (F.col("start") == F.col("final.start"))).alias("last"), "sound",
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that a range holds whole, and the parts at its ends.

    ``kind``: 0 a whole record, 1 the end of one begun before, 2 the begin of one that goes on,
    3 a range within one record.
    """
    here, state = None, None
    out: list[tuple] = []

    def closed() -> list[tuple]:
        """The part that is left when a range ends."""
        if state is None or not state["parts"]:
            return []
        return [(*here, 2 if state["ended"] else 3, "".join(state["parts"]))]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*_PLACE, "kind", "text"])

    names = ("value", *_PLACE, "in_string", "depth", "sound")
    for batch in batches:
        for value, file, start, in_string, depth, sound in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if not sound:
                raise ValueError(f"{file} does not hold one whole JSON array")
            if (file, start) != here:
                out += closed()
                here = (file, start)
                state = {"in": in_string, "depth": depth, "ended": depth <= 1 and not in_string, "parts": []}
            state["in"], deeper = _scan(value, state["in"])
            state["depth"] += deeper - (not state["in"])
            state["parts"].append(value + _END)
            if not state["in"] and state["depth"] == 1:
                out.append((*here, 0 if state["ended"] else 1, "".join(state["parts"])))
                state["ended"], state["parts"] = True, []
        yield batch_of(out)
        out = []
    yield batch_of(closed())


def json_array_records(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """``(file, text)``: the objects of files that hold one JSON array each, in several tasks.

    With ``parts`` the files are one array put together, as ``write_json_array`` leaves them: a
    part ends with a line end, between two records.

    Records that lie within a byte range never move; only the parts at the ends of ranges do,
    which are put together by file, in the order of their ranges.  Brackets, quotes and
    escapes within strings are text.  A file that ends within a string or bracket is an error;
    an empty array, or an empty file, has no records.
    """
    ship_package(spark)
    pieces = _pieces(spark, path, _END)
    # A row for each range: as many as there are tasks.
    starts = F.broadcast(_starts(pieces.mapInArrow(_summed, _SUMS), _whole(path, parts)))
    cut = pieces.join(starts, _PLACE).mapInArrow(_cut, "file string, start long, kind int, text string")
    # A record begins with each part of kind 2, in the order of ranges; kinds 1 and 3 go on.
    seams = cut.filter("kind > 0").withColumn("place", F.when(F.col("kind") == 2, 1).otherwise(0))
    begun = F.sum((F.col("kind") == 2).cast("int")).over(Window.partitionBy("file").orderBy("start", "place"))
    joined = (
        seams.withColumn("record", begun)
        .groupBy("file", "record")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "place", "text"))), lambda p: p["text"]), "").alias("text"))
    )
    every = cut.filter("kind = 0").select("file", "text").unionByName(joined.select("file", "text"))
    # What stands before a record: the bracket of the array or a comma.  What comes after the
    # last one is no record.
    bare = F.regexp_replace("text", r"^[\s,\[\x{FEFF}]+", "")
    return every.select("file", bare.alias("text")).filter(F.col("text").startswith("{"))


def read_json_array(spark: SparkSession, path: str, schema: StructType, parts: bool = False) -> DataFrame:
    """Records of JSON arrays by ``schema``; one that does not parse is an error that shows it."""
    bad = "_bad"
    with_bad = StructType([*schema.fields]).add(bad, "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    parsed = json_array_records(spark, path, parts).select(F.from_json("text", with_bad, options).alias("r"))
    broken = F.raise_error(F.concat(F.lit("Invalid record: "), F.substring(f"r.{bad}", 1, 200)))
    first = schema.fieldNames()[0]
    checked = F.when(F.col(f"r.{bad}").isNotNull(), broken.cast(schema[first].dataType)).otherwise(F.col(f"r.{first}"))
    return parsed.select(checked.alias(first), *[F.col(f"r.{c}").alias(c) for c in schema.fieldNames()[1:]])


def write_json_array(rows: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """Text files that, put together in the order of their names, are one JSON array.

    Every part but the first begins with a comma; an empty table is ``[]``.  With ``one_file``
    the last step is one task, which writes what the others have made in their order.
    """
    from folioforge.operators.ranks import number_rows

    lines = rows.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.to_json(F.struct(*rows.columns)).alias("json"))
    numbered = number_rows(lines, [f"_o{i}" for i in range(len(order))], "place").select("place", "json")
    n = numbered.agg(F.count("*")).first()[0]
    if n == 0:
        rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.text(path)
        return
    opened = F.when(F.col("place") == 0, F.lit("[")).otherwise(F.lit(","))
    closed = F.when(F.col("place") == n - 1, F.lit("]")).otherwise(F.lit(""))
    ordered = numbered.repartitionByRange("place").sortWithinPartitions("place")
    parts = ordered.select(F.concat(opened, "json", closed).alias("value"))
    (parts.coalesce(1) if one_file else parts).write.text(path)
