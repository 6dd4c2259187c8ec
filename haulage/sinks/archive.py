"""ZIP-of-CSV and XLSX sinks as Spark Python data sources.

Each write is a job with a name of its own, and a folder ``job-<name>`` under the output. Executor
tasks stream Arrow batches of their partitions straight into files there, named by partition,
number and task attempt. A job is published by one small marker file that lists the files of the
successful attempts: until it is there, readers see what was there before, and files of failed
attempts are never listed. Appending adds a job; overwriting publishes the new job and only then
removes the older ones, so a crash in between leaves rows twice at worst, never none.

Values are turned into text by Spark first (JVM casts), so that the Python side
only escapes and frames bytes, with vectorised Arrow kernels.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import uuid
import zipfile
from dataclasses import dataclass, field
from typing import Iterator
from xml.sax.saxutils import escape as xml_escape

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter,
                                    InputPartition, WriterCommitMessage)
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DecimalType, IntegralType, NumericType, StringType, StructField, StructType

from haulage.operators.columns import _quote
from haulage.sinks.writers import flat_for_text

# Fixed values of the file formats.
XLSX_MAX_DATA_ROWS = 1_048_575          # sheet rows minus the header row
ZIP_DATE_TIME = (1980, 1, 1, 0, 0, 0)   # fixed entry time: identical input, identical archive
XLSX_MAX_CELL_CHARS = 32_767
EXACT_DOUBLE_INT = 2**53                # larger integers lose digits in a number cell
EXACT_DOUBLE_DIGITS = 15                # decimals of more digits may, too
MARKER = "_published-"

# characters a sheet cannot hold as they are; written as _xHHHH_
_ESCAPED_XML = [*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x0D]


def _fs(path: str):
    """(filesystem, path inside it) for local paths and URIs (hdfs://, s3://, ...)."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _attempt() -> tuple[int, int, int]:
    """Partition, task attempt id (no other attempt has it), and how many attempts came before."""
    from pyspark import TaskContext
    ctx = TaskContext.get()
    return (0, 0, 0) if ctx is None else (ctx.partitionId(), ctx.taskAttemptId(), ctx.attemptNumber())


@dataclass
class StagedFiles(WriterCommitMessage):
    files: list = field(default_factory=list)   # (name, rows)


def published(path: str) -> list[str]:
    """Driver side: the files of all published jobs under ``path`` (from the markers, sorted)."""
    from pyarrow import fs as pafs
    fs, root = _fs(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [root]
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    files = []
    for info in found:
        if info.path.rsplit("/", 1)[-1].startswith(MARKER):
            with fs.open_input_stream(info.path) as marker:
                job = json.loads(marker.read())
            files += [f"{root}/{job['folder']}/{name}" for name, _ in job["files"]]
    return sorted(files)


class _JobWriter(DataSourceArrowWriter):
    suffix = ""
    default_level = 6   # zlib level of the deflated entries

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.schema = schema
        self.single = options.get("single_file", "false") == "true"
        self.entry = options.get("entry_name") or "part"
        limit = int(options.get("rows_per_file") or 0)
        self.rows_per_file = limit if limit > 0 else self.max_rows()
        self.level = int(options.get("compresslevel") or self.default_level)
        self.job = uuid.uuid4().hex[:16]    # made once, on the driver; tasks get it with the writer
        self.folder = f"job-{self.job}"

    def max_rows(self) -> int:
        return 1 << 62

    # -- executor side
    def write(self, iterator: Iterator[pa.RecordBatch]) -> StagedFiles:
        fs, root = _fs(self.path)
        part, attempt, earlier = _attempt()
        fs.create_dir(f"{root}/{self.folder}", recursive=True)
        done, out, name, n_rows, seq = [], None, "", 0, 0

        def begin():
            entry = self.entry if self.single and not seq else f"{self.entry}-{part:05d}-{seq:03d}"
            name = f"{entry}{self.suffix}" if entry == self.entry and not earlier else f"{entry}-{attempt}{self.suffix}"
            return name, self.open(fs.open_output_stream(f"{root}/{self.folder}/{name}", compression=None), entry)

        for batch in iterator:
            start = 0
            while start < batch.num_rows:
                if out is None:
                    (name, out), n_rows = begin(), 0
                take = min(batch.num_rows - start, self.rows_per_file - n_rows)
                self.add(out, batch.slice(start, take), n_rows)
                n_rows += take
                start += take
                if n_rows >= self.rows_per_file:
                    self.close(out)
                    done.append((name, n_rows))
                    out, seq = None, seq + 1
        if out is None and not done:           # empty partition: still a valid file
            (name, out), n_rows = begin(), 0
        if out is not None:
            self.close(out)
            done.append((name, n_rows))
        return StagedFiles(files=done)

    # -- driver side
    def commit(self, messages: list[StagedFiles]) -> None:
        from pyarrow import fs as pafs
        fs, root = _fs(self.path)
        files = [list(f) for msg in messages if msg for f in msg.files]
        before = [i.path for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
                  if i.path.rsplit("/", 1)[-1].startswith(MARKER)] if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MARKER}{self.job}.json", compression=None) as out:
            out.write(json.dumps({"folder": self.folder, "files": files}).encode())
        # published from here on; what follows only clears up
        for marker in before:
            with fs.open_input_stream(marker) as old:
                folder = json.loads(old.read())["folder"]
            fs.delete_file(marker)
            fs.delete_dir(f"{root}/{folder}")
        listed = {name for name, _ in files}
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/{self.folder}")):
            if info.path.rsplit("/", 1)[-1] not in listed:   # failed or speculative attempts
                fs.delete_file(info.path)

    def abort(self, messages) -> None:
        fs, root = _fs(self.path)
        try:
            fs.delete_dir(f"{root}/{self.folder}")
        except (FileNotFoundError, OSError):
            pass

    # -- format hooks
    def open(self, stream, name):
        raise NotImplementedError

    def add(self, out, batch: pa.RecordBatch, rows_before: int) -> None:
        raise NotImplementedError

    def close(self, out) -> None:
        raise NotImplementedError


class _EpochWriter(DataSourceStreamArrowWriter):
    """A job writer's files, published by one marker per micro-batch.

    A marker bears the query's name and the batch id, so a batch that runs again (after a crash
    between its commit and Spark's note of it, or on restart) replaces its own marker: its rows are
    published once. Files go to one folder for the query; those that no marker lists are leftovers
    (:func:`remove_unpublished`).
    """

    def __init__(self, inner: _JobWriter, query: str):
        self.inner, self.query = inner, query
        inner.folder = f"job-{query}"      # Spark makes the writer anew for commits: no random name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> StagedFiles:
        # a run writes many batches into its folder: names must not meet again
        self.inner.entry = f"{self.inner.entry}-{uuid.uuid4().hex[:12]}"
        first = next((b for b in iterator if b.num_rows), None)
        return StagedFiles() if first is None else self.inner.write(itertools.chain([first], iterator))

    def commit(self, messages: list[StagedFiles], batchId: int) -> None:
        fs, root = _fs(self.inner.path)
        files = [list(f) for msg in messages if msg for f in msg.files]
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MARKER}{self.query}-{batchId:012d}.json", compression=None) as out:
            out.write(json.dumps({"folder": self.inner.folder, "files": files}).encode())

    def abort(self, messages: list[StagedFiles], batchId: int) -> None:
        fs, root = _fs(self.inner.path)
        for name in [name for msg in messages if msg for name, _ in msg.files]:
            try:
                fs.delete_file(f"{root}/{self.inner.folder}/{name}")
            except (FileNotFoundError, OSError):
                pass


def remove_unpublished(path: str) -> int:
    """Delete files that no marker lists (of killed or failed attempts); no query may be writing."""
    from pyarrow import fs as pafs
    fs, root = _fs(path)
    listed = set(published(path))
    gone = [i.path for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
            if i.type == pafs.FileType.File and i.path not in listed and "/job-" in i.path[len(root):]]
    for name in gone:
        fs.delete_file(name)
    return len(gone)


class _ZipOut:
    def __init__(self, stream, entry: str, header: bytes, level: int):
        self.stream = stream
        self.zf = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=level)
        info = zipfile.ZipInfo(entry, date_time=ZIP_DATE_TIME)
        info.compress_type = zipfile.ZIP_DEFLATED
        info.compress_level = level
        self.entry = self.zf.open(info, "w", force_zip64=True)
        self.entry.write(header)


class ZipCsvWriter(_JobWriter):
    """E5: each archive holds one CSV entry (header + rows), deflated."""

    suffix = ".zip"

    def open(self, stream, name):
        header = io.BytesIO()
        pcsv.write_csv(pa.table({c: pa.array([], pa.string()) for c in self.schema.names}), header,
                       pcsv.WriteOptions(include_header=True, quoting_style="needed"))
        return _ZipOut(stream, name + ".csv", header.getvalue(), self.level)

    def add(self, out: _ZipOut, batch, rows_before):
        buf = io.BytesIO()
        pcsv.write_csv(batch, buf, pcsv.WriteOptions(include_header=False, quoting_style="needed"))
        out.entry.write(buf.getvalue())

    def close(self, out: _ZipOut):
        out.entry.close()
        out.zf.close()
        out.stream.close()


def _col_letters(n: int) -> list[str]:
    out = []
    for i in range(n):
        s, k = "", i + 1
        while k:
            k, r = divmod(k - 1, 26)
            s = chr(65 + r) + s
        out.append(s)
    return out


# The smallest set of package parts a spreadsheet reader needs.
_CONTENT_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    '</Types>')
_ROOT_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
    'Target="xl/workbook.xml"/></Relationships>')
_WORKBOOK = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
_WORKBOOK_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
    'Target="worksheets/sheet1.xml"/></Relationships>')
_SHEET_HEAD = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
               '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
_SHEET_TAIL = "</sheetData></worksheet>"


def _concatenated(arr) -> memoryview:
    """All values of a string array back to back, straight from its data buffer (no copies)."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    if arr.type != pa.string():
        arr = arr.cast(pa.string())
    offsets = arr.buffers()[1]
    data = arr.buffers()[2]
    if data is None or len(arr) == 0:
        return memoryview(b"")
    first, last = (pa.Array.from_buffers(pa.int32(), len(arr) + 1, [None, offsets], offset=arr.offset)
                   .to_numpy()[[0, -1]])
    return memoryview(data)[int(first):int(last)]


def _xml_text(arr: pa.Array) -> pa.Array:
    """Escaped cell text. What looks like an escape gets its underscore escaped, so reading gives
    back every character."""
    arr = pc.replace_substring_regex(arr, r"_(x[0-9A-Fa-f]{4}_)", r"_x005F_\1")
    if pc.any(pc.match_substring_regex(arr, r"[\x00-\x08\x0B-\x1F]")).as_py():
        for code in _ESCAPED_XML:
            arr = pc.replace_substring(arr, chr(code), f"_x{code:04X}_")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        arr = pc.replace_substring(arr, a, b)
    return arr


def _inline(ref: pa.Array, text: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(ref, pa.scalar(' t="inlineStr"><is><t xml:space="preserve">'), text,
                                       pa.scalar("</t></is></c>"), "")


class _XlsxOut:
    def __init__(self, stream, names: list[str], level: int):
        self.stream = stream
        self.zf = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=level)
        for part, text in (("[Content_Types].xml", _CONTENT_TYPES), ("_rels/.rels", _ROOT_RELS),
                           ("xl/workbook.xml", _WORKBOOK), ("xl/_rels/workbook.xml.rels", _WORKBOOK_RELS)):
            self.zf.writestr(zipfile.ZipInfo(part, date_time=ZIP_DATE_TIME), text)
        info = zipfile.ZipInfo("xl/worksheets/sheet1.xml", date_time=ZIP_DATE_TIME)
        info.compress_type = zipfile.ZIP_DEFLATED
        info.compress_level = level
        self.sheet = self.zf.open(info, "w", force_zip64=True)
        cells = "".join(f'<c r="{ref}1" t="inlineStr"><is><t xml:space="preserve">{xml_escape(n)}</t></is></c>'
                        for ref, n in zip(_col_letters(len(names)), names))
        self.sheet.write((_SHEET_HEAD + f'<row r="1">{cells}</row>').encode("utf-8"))


class XlsxWriter(_JobWriter):
    """One worksheet per workbook, at most 1,048,575 data rows each.

    Numeric columns become number cells, everything else inline strings (no
    shared-string table, so memory stays flat). Empty cells stay empty. Numbers a double cannot
    hold (decimals of over 15 digits, integers beyond 2**53) become text cells with all their
    digits; text over the format's cell limit is an error.
    """

    suffix = ".xlsx"
    default_level = 1   # sheet XML is bulky; fast deflate keeps the writer ahead of the scan

    def max_rows(self) -> int:
        return XLSX_MAX_DATA_ROWS

    def __init__(self, options, schema, overwrite):
        super().__init__(options, schema, overwrite)
        self.rows_per_file = min(self.rows_per_file, XLSX_MAX_DATA_ROWS)
        self.numeric = [isinstance(f.dataType, NumericType) for f in schema.fields]
        self.letters = _col_letters(len(schema.fields))

    def open(self, stream, name):
        return _XlsxOut(stream, self.schema.names, self.level)

    def add(self, out: _XlsxOut, batch, rows_before):
        n = batch.num_rows
        row_no = pc.cast(pa.array(range(rows_before + 2, rows_before + 2 + n), pa.int64()), pa.string())
        cells = []
        for i, letter in enumerate(self.letters):
            col = batch.column(i)
            ref = pc.binary_join_element_wise(pa.scalar(f'<c r="{letter}'), row_no, pa.scalar('"'), "")
            text = pc.cast(col, pa.string())
            if self.numeric[i]:
                cell = pc.binary_join_element_wise(ref, pa.scalar("><v>"), text, pa.scalar("</v></c>"), "")
                if pa.types.is_floating(col.type):   # NaN / infinity are no numbers in a sheet
                    finite = pc.fill_null(pc.is_finite(col), True)
                    if not pc.all(finite).as_py():
                        cell = pc.if_else(finite, cell, _inline(ref, text))
                elif pa.types.is_integer(col.type):
                    exact = pc.fill_null(pc.and_(pc.greater_equal(col, -EXACT_DOUBLE_INT), pc.less_equal(col, EXACT_DOUBLE_INT)), True)
                    if not pc.all(exact).as_py():
                        cell = pc.if_else(exact, cell, _inline(ref, text))
            else:
                longest = pc.max(pc.utf8_length(text)).as_py() or 0
                if longest > XLSX_MAX_CELL_CHARS:
                    raise ValueError(f"column {self.schema.names[i]!r}: a text of {longest} characters does not fit a cell "
                                     f"({XLSX_MAX_CELL_CHARS})")
                cell = _inline(ref, _xml_text(text))
            cells.append(pc.fill_null(cell, ""))
        rows = pc.binary_join_element_wise(pa.scalar('<row r="'), row_no, pa.scalar('">'), *cells,
                                           pa.scalar("</row>"), "")
        out.sheet.write(_concatenated(rows))

    def close(self, out: _XlsxOut):
        out.sheet.write(_SHEET_TAIL.encode("utf-8"))
        out.sheet.close()
        out.zf.close()
        out.stream.close()


class _FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _zip_entry(fs, path: str):
    stream = fs.open_input_file(path)
    zf = zipfile.ZipFile(stream)
    names = [n for n in zf.namelist() if n.endswith(".csv")]
    if len(names) != 1:
        raise ValueError(f"{path}: expected one CSV entry, found {names}")
    return zf, names[0]


class ZipCsvReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self):
        return [_FilePartition(p) for p in published(self.path) if p.endswith(".zip")]

    def read(self, partition: _FilePartition):
        fs, _ = _fs(self.path)
        zf, entry = _zip_entry(fs, partition.path)
        names = self.schema.names
        convert = pcsv.ConvertOptions(column_types={n: pa.string() for n in names},
                                      strings_can_be_null=True, quoted_strings_can_be_null=False)
        with zf.open(entry) as fh:
            reader = pcsv.open_csv(fh, read_options=pcsv.ReadOptions(use_threads=False),
                                   parse_options=pcsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=len(names) > 1),
                                   convert_options=convert)
            for batch in reader:
                yield batch


class ZipCsvDataSource(DataSource):
    """``csv_zip``: sink of E5, and a reader of such archives (text columns)."""

    @classmethod
    def name(cls):
        return "csv_zip"

    def schema(self):
        files = [p for p in published(self.options["path"]) if p.endswith(".zip")]
        if not files:
            raise FileNotFoundError(f"no archives under {self.options['path']}")
        fs, _ = _fs(self.options["path"])
        zf, entry = _zip_entry(fs, files[0])
        with zf.open(entry) as fh:
            header = pcsv.open_csv(fh, parse_options=pcsv.ParseOptions(newlines_in_values=True)).schema.names
        return StructType([StructField(n, StringType(), True) for n in header])

    def reader(self, schema):
        return ZipCsvReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return ZipCsvWriter(self.options, schema, overwrite)

    def streamWriter(self, schema, overwrite):
        return _EpochWriter(ZipCsvWriter(self.options, schema, False), self.options["query"])


class XlsxDataSource(DataSource):
    """``xlsx_shards``: sink of E4."""

    @classmethod
    def name(cls):
        return "xlsx_shards"

    def writer(self, schema, overwrite):
        return XlsxWriter(self.options, schema, overwrite)

    def streamWriter(self, schema, overwrite):
        return _EpochWriter(XlsxWriter(self.options, schema, False), self.options["query"])


def register_sinks(spark: SparkSession) -> None:
    from haulage.session import ship_package
    ship_package(spark)
    spark.dataSource.register(ZipCsvDataSource)
    spark.dataSource.register(XlsxDataSource)


def _as_text(df: DataFrame) -> DataFrame:
    """All columns as strings, cast by Spark (the CSV sink's text forms)."""
    flat = flat_for_text(df)
    return flat.select(*[F.col(_quote(c)).cast("string").alias(c) for c in flat.columns])


def _for_sheet(df: DataFrame) -> DataFrame:
    flat = flat_for_text(df)
    cols = []
    for f in flat.schema.fields:
        c = F.col(_quote(f.name))
        if isinstance(f.dataType, IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, DecimalType) and f.dataType.precision > EXACT_DOUBLE_DIGITS:
            c = c.cast("string")
        elif isinstance(f.dataType, NumericType):
            c = c.cast("double")
        else:
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return flat.select(*cols)


def _save(df: DataFrame, fmt: str, path: str, single_file: bool, mode: str, **opts) -> str:
    register_sinks(df.sparkSession)
    if single_file:
        df = df.coalesce(1)
    w = df.write.format(fmt).mode(mode).option("single_file", "true" if single_file else "false")
    for k, v in opts.items():
        if v is not None:
            w = w.option(k, str(v))
    w.save(path)
    return path


def write_zip(df: DataFrame, path: str, entry_name: str | None = None, single_file: bool = False,
              mode: str = "overwrite", rows_per_file: int | None = None,
              compresslevel: int | None = None) -> str:
    """E5: CSV rows deflated into archives, one (or more, by ``rows_per_file``) per partition."""
    return _save(_as_text(df), "csv_zip", path, single_file, mode, entry_name=entry_name,
                 rows_per_file=rows_per_file, compresslevel=compresslevel)


def write_xlsx(df: DataFrame, path: str, entry_name: str | None = None, single_file: bool = False,
               mode: str = "overwrite", rows_per_file: int | None = None,
               compresslevel: int | None = None) -> str:
    """Sharded workbooks, one or more per partition."""
    return _save(_for_sheet(df), "xlsx_shards", path, single_file, mode, entry_name=entry_name,
                 rows_per_file=rows_per_file, compresslevel=compresslevel)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the CSV entries of the archives under ``path`` (all columns text)."""
    register_sinks(spark)
    return spark.read.format("csv_zip").load(path)


def _stream(df: DataFrame, fmt: str, path: str, checkpoint: str, trigger: str, **opts) -> StreamingQuery:
    register_sinks(df.sparkSession)
    # a query keeps its checkpoint over restarts, so that names it
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).option("path", path).option("query", query)
    for k, v in opts.items():
        if v is not None:
            w = w.option(k, str(v))
    w = w.trigger(availableNow=True) if trigger == "availableNow" else w.trigger(processingTime=trigger)
    return w.start()


def zip_stream(df: DataFrame, path: str, checkpoint: str, trigger: str = "availableNow", rows_per_file: int | None = None,
               compresslevel: int | None = None) -> StreamingQuery:
    """E5 of a stream: every micro-batch adds archives, published together; read with :func:`read_zip`."""
    return _stream(_as_text(df), "csv_zip", path, checkpoint, trigger, rows_per_file=rows_per_file, compresslevel=compresslevel)


def xlsx_stream(df: DataFrame, path: str, checkpoint: str, trigger: str = "availableNow", rows_per_file: int | None = None,
                compresslevel: int | None = None) -> StreamingQuery:
    """E4 of a stream: every micro-batch adds workbooks, published together."""
    return _stream(_for_sheet(df), "xlsx_shards", path, checkpoint, trigger, rows_per_file=rows_per_file, compresslevel=compresslevel)
