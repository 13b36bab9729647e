"""Delimited files and their importers (rows S1-S6, H36-H37)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimweave.functions import keys
from claimweave.plans.materialize import cut

#: Columns of the federal candidate file.
FEDERAL_COLUMNS = (
    "CAND_ID", "CAND_NAME", "CAND_PTY_AFFILIATION", "CAND_ELECTION_YR", "CAND_OFFICE_ST", "CAND_OFFICE", "CAND_OFFICE_DISTRICT", "CAND_ICI",
    "CAND_STATUS", "CAND_PCC", "CAND_ST1", "CAND_ST2", "CAND_CITY", "CAND_ST", "CAND_ZIP"
)
#: Pieces of files whose table is given to all tasks; with more of them, lines are joined to their pieces by a shuffle.
BROADCAST_PIECES = 100_000
OFFICES, STATUSES = ("H", "S", "P"), ("C", "N")


def unwrapped(raw: bytes) -> bytes:
    """What a zip archive of one file holds; other bytes as they are. Archives of none or several are an error."""
    held = io.BytesIO(raw)
    if not raw.startswith(b"PK") or not zipfile.is_zipfile(held):
        return raw
    with zipfile.ZipFile(held) as archive:
        files = [entry for entry in archive.infolist() if not entry.is_dir()]
        if len(files) == 1:
            return archive.read(files[0])
    raise ValueError(f"an archive of {len(files)} members")


def _goes_on(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line, given whether one was at its beginning.

    Only a quote at the beginning of a field opens one.
    """
    at = 0
    while True:
        if not inside and line[at : at + 1] == '"':
            inside, at = True, at + 1
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside = False
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def records(raw: bytes, delimiter: str = ",") -> Iterator[str]:
    """The records of a delimited file as text, blank ones left out; a record ends at a line's end outside quotes."""
    held, inside = [], False
    for line in io.StringIO(unwrapped(raw).decode("utf-8-sig", "replace"), newline=""):
        held.append(line)
        inside = _goes_on(line, delimiter, inside)
        if not inside:
            if record := "".join(held).rstrip("\r\n"):
                yield record
            held = []
    if held:
        yield "".join(held)


def _zipped(spark: SparkSession, path: str) -> bool:
    """Whether a file begins as a zip archive does."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return [stream.read(), stream.read()] == [0x50, 0x4B]
    finally:
        stream.close()


def _unzipped(spark: SparkSession, paths: list[str], delimiter: str, header: bool) -> DataFrame:
    """``path, index, record`` of archives, each read whole by one task, since they cannot be cut."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, raw in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                found = records(raw, delimiter)
                if header:
                    next(found, None)
                numbered = enumerate(found)
                while held := list(islice(numbered, 10_000)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(held)), pa.array([k for k, _ in held], pa.int64()), pa.array([x for _, x in held])],
                        ["path", "index", "record"]
                    )

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "path string, index long, record string")


def _line_batches(parts: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """(key, line) of a task's lines in order, the key being path, start of the piece and what else is named; line ends stay."""
    for part in parts:
        for *key, value in zip(*(part.column(c).to_pylist() for c in (*names, "value"))):
            if "\r" in value[:-1]:
                for line in io.StringIO(value + "\n", newline=""):
                    yield key, line
            else:
                yield key, value + "\n"


def _pieces(lines: DataFrame, delimiter: str) -> DataFrame:
    """For each piece of a file, entered outside or inside of quotes: whether it is left inside, and how many records begin."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for key, line in _line_batches(parts, "path", "start"):
            if not held or held[-1][:2] != key:
                if len(held) > 1000:
                    yield told(held[:-1])
                    held = held[-1:]
                held.append([*key, False, 0, True, 0])
            one = held[-1]
            for at, inside in ((2, one[2]), (4, one[4])):
                if not inside:
                    one[at + 1] += line not in ("\n", "\r\n", "\r")
                one[at] = _goes_on(line, delimiter, inside)
        if held:
            yield told(held)

    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
    names = ["path", "start", "out_ends_in", "out_records", "in_ends_in", "in_records"]
    told = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
    return lines.mapInArrow(run, "path string, start long, out_ends_in boolean, out_records long, in_ends_in boolean, in_records long")


def _composed(pieces: DataFrame) -> DataFrame:
    """``path, start, inside, first, ends_in``: how each piece is entered and left, and the number of its first record.

    A file's pieces are few short rows; their transitions are chained in order.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, inside, first, out = rows.sort_values("start"), False, 0, []
        for r in rows.itertuples():
            ends, n = (r.in_ends_in, r.in_records) if inside else (r.out_ends_in, r.out_records)
            out.append((r.path, r.start, inside, first, ends))
            inside, first = ends, first + n
        return pd.DataFrame(out, columns=["path", "start", "inside", "first", "ends_in"])

    return pieces.groupBy("path").applyInPandas(run, "path string, start long, inside boolean, first long, ends_in boolean")


def _cut(lines: DataFrame, delimiter: str) -> DataFrame:
    """``path, index, record, start, whole`` of lines with their pieces; a record that goes over a piece's end comes in parts."""
    names = ["path", "index", "record", "start", "whole"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, piece, text = [], None, []
        inside = begun = False
        index = -1
        for key, line in _line_batches(parts, "path", "start", "inside", "first"):
            if key != piece:
                if text:
                    out.append((piece[0], index, "".join(text), piece[1], False))
                piece, text = key, []
                inside, begun, index = key[2], not key[2], key[3] - 1
            if not inside and not text:
                if line in ("\n", "\r\n", "\r"):
                    continue
                index += 1
            text.append(line)
            inside = _goes_on(line, delimiter, inside)
            if not inside:
                out.append((piece[0], index, "".join(text), piece[1], begun))
                text, begun = [], True
            if len(out) >= 10_000:
                yield told(out)
                out = []
        if text:
            out.append((piece[0], index, "".join(text), piece[1], False))
        if out:
            yield told(out)

    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    told = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
    return lines.mapInArrow(run, "path string, index long, record string, start long, whole boolean")


def _split(spark: SparkSession, paths: list[str], delimiter: str, header: bool) -> DataFrame:
    """``path, index, record`` of files that many tasks read, each its own pieces, wherever these are cut."""
    read = spark.read.text(paths, lineSep="\n")
    # The order of a piece's lines is that in which its task reads them.
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("value"))
    bom = (F.col("start") == 0) & F.col("value").startswith("\ufeff")
    lines = lines.withColumn("value", F.when(bom, F.substring("value", 2, 2_147_483_647)).otherwise(F.col("value")))
    pieces = cut(_composed(_pieces(lines, delimiter)))
    told = pieces.select("path", "start", "inside", "first")
    lost = F.raise_error(F.lit("a file was cut differently when it was read again"))
    if pieces.count() <= BROADCAST_PIECES:  # five short values for each piece
        met = lines.join(F.broadcast(told), ["path", "start"], "left")
    else:
        met = lines.withColumn("k", F.monotonically_increasing_id()).join(told, ["path", "start"], "left")
        met = met.repartition("path", "start").sortWithinPartitions("path", "start", "k")
    met = met.select("path", "start", F.when(F.col("first").isNull(), lost.cast("boolean")).otherwise(F.col("inside")).alias("inside"), "first", "value")
    found = _cut(met, delimiter)
    out = found.where("whole").select("path", "index", "record")
    if not pieces.where("inside or ends_in").isEmpty():
        parts = found.where("not whole").groupBy("path", "index").agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"))
        out = out.unionByName(parts.select("path", "index", F.array_join("p.record", "").alias("record")))
    out = out.withColumn("record", F.regexp_replace("record", r"[\r\n]+$", ""))
    return out.where("index > 0").withColumn("index", F.col("index") - 1) if header else out


def rows(spark: SparkSession, path: str, names: Iterable[str], delimiter: str = ",", header: bool = False) -> DataFrame:
    """Files, also zipped, as ``path, index`` and the named columns, stripped; what is missing is empty.

    The index is zero-based and the same on every read: a record's place in its file, blank ones not counted. A file is
    read by as many tasks as it has pieces: a first pass finds, for each piece and either state of quotes at its
    beginning, the state at its end and how many records begin; chained, these say how each piece is entered and what
    its first record's number is, and a second pass cuts the records. Only records that a cut divides are put together
    by a shuffle. A zip archive is read by one task. Bytes that are no UTF-8 become replacement characters.
    """
    found = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # the files' names
    zipped = [p for p in found if _zipped(spark, p)]
    plain = [p for p in found if p not in set(zipped)]
    parts = [_unzipped(spark, zipped, delimiter, header)] if zipped else []
    parts += [_split(spark, plain, delimiter, header)] if plain else []
    if not parts:
        parts = [spark.createDataFrame([], "path string, index long, record string")]
    cut_ = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fields = ", ".join(f"`{n}` string" for n in names)
    quoted = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    read = cut_.select("path", "index", F.from_csv("record", fields, quoted).alias("r"))
    return read.select("path", "index", *(F.coalesce(F.trim(F.col("r")[n]), F.lit("")).alias(n) for n in names))


def locator(index: Column) -> Column:
    """The place that an imported row's evidence points to."""
    return F.concat(F.lit("/rows/"), index.cast("string"))


def table(spark: SparkSession, path: str, ddl: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """S1 where no index is needed: a splittable scan with a declared schema, values trimmed."""
    read = spark.read.schema(ddl).csv(path, sep=delimiter, header=header, mode="PERMISSIVE", quote='"', escape='"')
    return read.select(*(F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in read.dtypes))


def divisions(scan: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """``scan(id, name)`` with ``kept``: a well-formed id, a name, and a last level of these kinds."""
    fine = F.col("id").rlike(r"^ocd-division/country:[a-z]{2}(/[a-z_]+:[^/]+)*$") & (F.coalesce(F.trim("name"), F.lit("")) != "")
    return scan.withColumn("kept", F.coalesce(fine & keys.division_level(F.col("id")).isin(*kinds), F.lit(False)))


def federal_candidates(scan: DataFrame, cycle: int, offices: Iterable[str] = OFFICES) -> DataFrame:
    """Usable rows of the candidate file, an accidental header dropped, with their contest key.

    A row that lacks the state of its seat has no key, and ``error`` says so.
    """
    usable = F.col("CAND_OFFICE").isin(*offices) & F.col("CAND_STATUS").isin(*STATUSES) & (
        F.trim("CAND_ELECTION_YR") == str(cycle)
    ) & (F.upper("CAND_ID") != "CAND_ID") & (F.trim("CAND_ID") != "") & (F.trim("CAND_NAME") != "")
    key = keys.federal_contest_key(
        F.col("CAND_OFFICE"), F.col("CAND_OFFICE_ST"), F.col("CAND_OFFICE_DISTRICT"), F.lit(cycle), F.col("CAND_PTY_AFFILIATION")
    )
    kept = scan.where(F.coalesce(usable, F.lit(False))).withColumn("contest_key", key)
    return kept.withColumn("error", F.when(F.col("contest_key").isNull(), F.concat(F.col("CAND_ID"), F.lit(" has no office state"))))


def report(scan: DataFrame) -> DataFrame:
    """Rows kept and filtered, one row."""
    return scan.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("filtered"))
