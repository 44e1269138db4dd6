"""Drifted schema rewrite: a chain of migrations on Parquet files whose schemas have drifted from the evolved one.

Method. Fields are known by their Parquet field ids, never by names. Each file's footer says how its schema has drifted, a bit a kind:
names (1), order (2), missing fields (4), narrower types (8). For each bit there is one transform: `rename`, `reorder`, `add` and `widen`. They
compose: each takes and gives a plan, a list of columns with the place in the file that they come from, or the default they are made of. The
chain of a file is put together from its bits and worked out on the schema alone; batches then pass through the fused plan once, one record
batch at a time. Files without drift are not opened beyond the footer and stay as they are.

Files. A file is rewritten by one task that streams it: to a name of its own outside of the folder, which is moved into it when it is whole.
New files stand beside the old ones until the report of all is written; only then are the old ones deleted, so a task that is lost
at any time can run again: what it reads is still there, and what it makes has the same names and bytes. Listing, rewriting, deleting and
reading back are jobs over the files; nothing but counts reaches the driver. Files are reached through pyarrow's file systems, by
the URI of the folder.

Cases. Values are kept as they are (null, not a number, empty texts); only fields that a file lacks get their default. Columns of ids that the
evolved schema has not are left out (that is drift of order). A type that does not widen safely, or a field id that stands twice or
nowhere, is an error. Files without rows are rewritten as any other; an empty folder or table gives no rows."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import checkpointed, digest, shared_folder, ship
from .prefix import with_prefix

RENAME, REORDER, ADD, WIDEN = 1, 2, 4, 8
FIELD_ID = b"PARQUET:field_id"
SAFE = {(pa.int32(), pa.int64()), (pa.float32(), pa.float64()), (pa.int16(), pa.int64()), (pa.int16(), pa.int32()), (pa.int32(), pa.float64())}
ROW_GROUP = 65_536

# Fixed values of the contract: the table's fields in order, and what missing ones become.
CLIENTS = pa.schema(
    [
        pa.field(name, kind, metadata={FIELD_ID: str(k).encode()})
        for k, (name, kind) in enumerate(
            [
                ("client_id", pa.int64()), ("master_id", pa.int64()), ("source", pa.string()), ("updated_at", pa.timestamp("us")), ("name", pa.string()),
                ("email", pa.string()), ("city", pa.string()), ("nation_id", pa.int64()), ("segment", pa.string()), ("balance", pa.float64()),
            ],
            1,
        )
    ]
)
DEFAULTS = {"nation_id": -1, "segment": "none"}
VERSIONS, DRIFTS, FILES = 24, 16, 250
NEW = ["n_rows", "n_nulls", "ids_sha256", "rows_sha256", "columns"]


def field_id(field: pa.Field) -> int:
    found = (field.metadata or {}).get(FIELD_ID)
    if found is None:
        raise ValueError(f"the field {field.name} has no id")
    return int(found)


@dataclass(frozen=True)
class Column:
    """A column of a plan: the field it is so far, and where its values come from: a place in the file, or a default."""

    field: pa.Field
    place: int | None = None
    default: object = None


Plan = list[Column]


def plan_of(schema: pa.Schema) -> Plan:
    plan = [Column(f, k) for k, f in enumerate(schema)]
    if len({field_id(c.field) for c in plan}) < len(plan):
        raise ValueError("a field id stands twice")
    return plan


def _fields(target: pa.Schema) -> dict[int, pa.Field]:
    return {field_id(f): f for f in target}


def widen(plan: Plan, target: pa.Schema, defaults: dict) -> Plan:
    fields = _fields(target)

    def wide(c: Column) -> Column:
        want = fields.get(field_id(c.field))
        if want is None or want.type == c.field.type:
            return c
        if (c.field.type, want.type) not in SAFE:
            raise ValueError(f"{c.field.name}: {c.field.type} does not widen to {want.type}")
        return replace(c, field=c.field.with_type(want.type))

    return [wide(c) for c in plan]


def add(plan: Plan, target: pa.Schema, defaults: dict) -> Plan:
    have = {field_id(c.field) for c in plan}
    return plan + [Column(f, None, defaults.get(f.name)) for f in target if field_id(f) not in have]


def reorder(plan: Plan, target: pa.Schema, defaults: dict) -> Plan:
    place = {i: k for k, i in enumerate(_fields(target))}
    return sorted((c for c in plan if field_id(c.field) in place), key=lambda c: place[field_id(c.field)])


def rename(plan: Plan, target: pa.Schema, defaults: dict) -> Plan:
    fields = _fields(target)
    return [replace(c, field=c.field.with_name(fields[i].name)) if (i := field_id(c.field)) in fields else c for c in plan]


#: A transform for each bit. Added fields come last, and are put in their places by the order.
TRANSFORMS = [(WIDEN, widen), (ADD, add), (REORDER, reorder), (RENAME, rename)]


def drift(schema: pa.Schema, target: pa.Schema) -> int:
    """The bits of what differs between a file's schema and the evolved one."""
    fields, plan = _fields(target), plan_of(schema)
    ids = [field_id(c.field) for c in plan]
    known = [(c.field, fields[i]) for c, i in zip(plan, ids, strict=True) if i in fields]
    bits = RENAME * any(f.name != want.name for f, want in known)
    bits |= REORDER * (ids != [i for i in fields if i in ids])
    bits |= ADD * any(i not in ids for i in fields)
    return bits | WIDEN * any(f.type != want.type for f, want in known)


def chain(schema: pa.Schema, target: pa.Schema, defaults: dict) -> Plan | None:
    """The fused plan of a file with this schema; None if nothing has drifted."""
    bits = drift(schema, target)
    if not bits:
        return None
    plan = plan_of(schema)
    for bit, transform in TRANSFORMS:
        # an added field has to be put in its place, too
        if bits & bit or bit == REORDER and bits & ADD:
            plan = transform(plan, target, defaults)
    return plan


def migrated(batch: pa.RecordBatch, plan: Plan, target: pa.Schema) -> pa.RecordBatch:
    """The batch by the evolved schema: each column is cast, made or taken once."""
    columns = [pa.array([c.default], c.field.type).take(pa.array([0] * batch.num_rows, pa.int32())) if c.place is None else batch.column(c.place).cast(c.field.type) for c in plan]
    return pa.RecordBatch.from_arrays(columns, schema=target)


# files


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def _move(fs: pa.fs.FileSystem, source: str, target: str) -> None:
    try:
        fs.move(source, target)
    except OSError:
        # left by an earlier run of this task, on file systems that do not move onto a file
        fs.delete_file(target)
        fs.move(source, target)


def written(batches: Iterator[pa.RecordBatch], schema: pa.Schema, uri: str, spare: str) -> None:
    """A Parquet file of these batches, which is there as a whole or not at all; `spare`: a folder for what is not whole."""
    fs, target = opened(uri)
    _, folder = opened(spare)
    fs.create_dir(folder, recursive=True)
    fs.create_dir(target.rpartition("/")[0], recursive=True)
    unfinished = f"{folder}/{uuid.uuid4().hex}.parquet"
    with fs.open_output_stream(unfinished) as out, pq.ParquetWriter(out, schema) as writer:
        for b in batches:
            writer.write_batch(b, row_group_size=ROW_GROUP)
    _move(fs, unfinished, target)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """path: the Parquet files of a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"))


def rewrite(files: DataFrame, target: pa.Schema, defaults: dict, spare: str) -> DataFrame:
    """version (the bits of drift), start_columns, path, rewritten: a row for each of the files (path), which are as the target says then.

    Rewritten files have a new name in the same folder; the old ones are deleted when all are done."""

    def run(batches):
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                fs, at = opened(path)
                with fs.open_input_file(at) as f:
                    start = pq.ParquetFile(f)
                    schema, final = start.schema_arrow, path
                    if plan := chain(schema, target, defaults):
                        final = path.removesuffix(".parquet") + "-evolved.parquet"
                        written((migrated(x, plan, target) for x in start.iter_batches(ROW_GROUP)), target, final, spare)
                found.append((drift(schema, target), ",".join(schema.names), path, final, plan is not None))
            columns = zip(*found, strict=True) if found else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["version", "start_columns", "old", "path", "rewritten"])

    def drop(batches):
        for b in batches:
            for old, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                fs, at = opened(old)
                if old != path and fs.get_file_info(at).type != pa.fs.FileType.NotFound:
                    fs.delete_file(at)
            yield b

    schema = "version long, start_columns string, old string, path string, rewritten boolean"
    # paths are few bytes: without a number, all files would be put into one task
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    report = checkpointed(ship(files).repartition(tasks, "path").mapInArrow(run, schema))
    return checkpointed(report.mapInArrow(drop, schema)).drop("old")


def read_back(files: DataFrame) -> DataFrame:
    """`files` (with path), and of each file, streamed: n_rows, n_nulls, ids_sha256 (of the first column), rows_sha256, columns.

    A timestamp stands as microseconds since 1970, a double as floor(2^20 x), or as nan, inf and -inf; a null as `?`."""

    def said(column: pa.Array) -> list[str]:
        if pa.types.is_timestamp(column.type):
            column = column.cast(pa.int64())
        if pa.types.is_floating(column.type):
            return ["?" if x is None else str(math.floor(1048576 * x)) if math.isfinite(x) else str(x) for x in column.to_pylist()]
        return ["?" if x is None else str(x) for x in column.to_pylist()]

    def run(batches):
        for b in batches:
            made = []
            for path in b.column(b.schema.get_field_index("path")).to_pylist():
                fs, at = opened(path)
                n, nulls, ids, rows = 0, 0, hashlib.sha256(), hashlib.sha256()
                with fs.open_input_file(at) as f:
                    file = pq.ParquetFile(f)
                    for x in file.iter_batches(ROW_GROUP):
                        columns = [said(c) for c in x.columns]
                        ids.update((("," if n else "") + ",".join(columns[0])).encode("utf-8", "surrogatepass"))
                        rows.update((("\n" if n else "") + "\n".join(map("|".join, zip(*columns, strict=True)))).encode("utf-8", "surrogatepass"))
                        n, nulls = n + x.num_rows, nulls + sum(c.null_count for c in x.columns)
                    made.append((n, nulls, ids.hexdigest(), rows.hexdigest(), ",".join(file.schema_arrow.names)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            new = [pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *NEW])

    new = [T.StructField(name, kind) for name, kind in zip(NEW, [T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType()], strict=True)]
    return ship(files).mapInArrow(run, T.StructType([*files.schema.fields, *new]))


# the drifted files of the contract


def drifted(target: pa.Schema, bits: int) -> tuple[pa.Schema, list[int]]:
    """The schema of a file that has drifted by these bits, and which of the target's fields it has, in its order."""
    places = list(range(len(target)))
    if bits & ADD:
        places = [k for k in places if target.field(k).name not in DEFAULTS]
    if bits & REORDER:
        places = places[:1] + places[:0:-1]
    swapped = {"name": "email", "email": "name"} if bits & RENAME else {}
    narrow = {"balance": pa.float32(), "nation_id": pa.int32()} if bits & WIDEN else {}
    fields = [target.field(k) for k in places]
    return pa.schema([f.with_type(narrow.get(f.name, f.type)).with_name(swapped.get(f.name, f.name)) for f in fields]), places


def version_of(file_no):
    """The bits by which the file of this number has drifted, as a column."""
    bits = F.crc32(F.concat(F.lit("19:"), file_no.cast("string")).cast("binary")) % VERSIONS
    return F.when(bits < DRIFTS, bits).otherwise(0).cast("long")


def write_drifted(clients: DataFrame, folder: str, spare: str, target: pa.Schema = CLIENTS, files: int = FILES) -> DataFrame:
    """file_no, path: files of the table's rows by checksum of the id, drifted by what their numbers say.

    Rows are dealt by ranges to be numbered, then by the number of their file, which one task writes as rows come."""
    kinds = {"client_id": "long", "master_id": "long", "updated_at": "timestamp_ntz", "nation_id": "long", "balance": "double"}
    rows = clients.select(*[F.col(n).cast(kinds.get(n, "string")).alias(n) for n in target.names])
    n = rows.count()
    # null ids last, equal ids by all their values
    order = [F.coalesce(F.crc32(F.col("client_id").cast("string").cast("binary")), F.lit(2**32)), F.col("client_id"), digest(*[F.col(c) for c in target.names])]
    placed = with_prefix(rows, order, []).withColumn("file_no", F.floor(F.col("__row") / F.lit(1 + n // files)).cast("long"))
    dealt = placed.select("file_no", version_of(F.col("file_no")).alias("version"), "__row", *target.names).repartitionByRange("file_no").sortWithinPartitions("file_no", "__row")

    def parts(batches):
        for b in batches:
            numbers = b.column(0).to_numpy()
            start = 0
            while start < len(numbers):
                end = int(numbers.searchsorted(numbers[start], "right"))
                yield b.slice(start, end - start)
                start = end

    def run(batches):
        pieces = parts(batches)
        piece = next(pieces, None)
        while piece:
            number, bits = piece.column(0)[0].as_py(), piece.column(1)[0].as_py()
            schema, places = drifted(target, bits)

            def rows_of(number=number, schema=schema, places=places):
                nonlocal piece
                while piece and piece.column(0)[0].as_py() == number:
                    yield pa.RecordBatch.from_arrays([piece.column(3 + k).cast(f.type, safe=False) for k, f in zip(places, schema, strict=True)], schema=schema)
                    piece = next(pieces, None)

            path = f"{folder}/file-{number:05d}.parquet"
            written(rows_of(), schema, path, spare)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([path])], names=["file_no", "path"])

    return ship(dealt).mapInArrow(run, "file_no long, path string")


def rewritten_clients(spark: SparkSession, clients: DataFrame, target: pa.Schema = CLIENTS, files: int = FILES) -> DataFrame:
    """The contract's report: drifted files are written to a new shared folder, rewritten there, and read back."""
    home = f"{shared_folder(spark).rstrip('/')}/clients-{uuid.uuid4().hex}"
    if checkpointed(write_drifted(clients, f"{home}/table", f"{home}/unfinished", target, files)).isEmpty():
        found = files_none(spark)
    else:
        found = rewrite(files_of(spark, f"{home}/table"), target, DEFAULTS, f"{home}/unfinished")
    numbered = found.withColumn("file_no", F.regexp_extract("path", r"file-([0-9]+)[^/]*$", 1).cast("long"))
    return checkpointed(read_back(numbered)).select("file_no", "version", *NEW[:4], "start_columns", "columns", "path", "rewritten")


def files_none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "version long, start_columns string, path string, rewritten boolean")
