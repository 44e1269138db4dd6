"""The rewrite of drifted files: each transform, every mix of them, and the whole contract against plain Python."""

import datetime
import hashlib
import math
import os
import struct
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quernstone.llm import migrate

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, path string, version int"
NAMES = migrate.CLIENTS.names


def rows(n):
    when = datetime.datetime(2024, 1, 31, 23, 59, 59, 123456)
    made = [(i, i // 2, "crm", when + datetime.timedelta(minutes=i), f"n|{i}", f"é{i}@x", "c\n", i % 25, "web", i / 7 - 3) for i in range(n)]
    odd = [
        (n, None, None, None, None, None, None, None, None, None),
        (None, 1, "", when, "", "?", "none", -1, "none", float("nan")),
        (n + 1, 1, "", datetime.datetime(1969, 12, 31, 23), "x", "y", "z", 3, "s", float("-inf")),
        (n + 1, 2, "", None, "x" * 100_000, "y", "z", 3, "s", -0.1),
        (n + 2, 2, "", None, "same", "y", "z", 3, "s", 0.1),
        (n + 2, 2, "", None, "same", "y", "z", 3, "s", 0.1),
    ]
    return made + odd


def said(row):
    d = dict(zip(NAMES, row, strict=True))
    if d["updated_at"] is not None:
        d["updated_at"] = (d["updated_at"] - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    if d["balance"] is not None:
        d["balance"] = math.floor(1048576 * d["balance"]) if math.isfinite(d["balance"]) else d["balance"]
    return "|".join("?" if d[c] is None else str(d[c]) for c in NAMES)


def lost(row, bits):
    d = dict(zip(NAMES, row, strict=True))
    if bits & 4:
        d |= {"nation_id": -1, "segment": "none"}
    if bits & 8 and d["balance"] is not None:
        d["balance"] = struct.unpack("f", struct.pack("f", d["balance"]))[0]
    return tuple(d[c] for c in NAMES)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def version(number):
    v = zlib.crc32(f"19:{number}".encode()) % 24
    return v if v < 16 else 0


def test_rewritten_clients(spark):
    table = rows(700)
    df = spark.createDataFrame([(*r, "clash", 7) for r in table], SCHEMA).repartition(5)
    got = {r.file_no: r for r in migrate.rewritten_clients(spark, df).collect()}
    per = 1 + len(table) // 250
    # equal ids stand together, null ids last; which of two rows of one id is first is told from the file
    table.sort(key=lambda r: (r[0] is None, zlib.crc32(str(r[0]).encode()), r[0] or 0))
    assert sorted(got) == list(range(-(-len(table) // per)))
    kinds = set()
    for number, r in got.items():
        part, bits = table[number * per : (number + 1) * per], version(number)
        kinds.add(bits)
        assert (r.version, r.n_rows, r.rewritten, r.columns) == (bits, len(part), bits > 0, ",".join(NAMES))
        assert r.ids_sha256 == sha(",".join("?" if x[0] is None else str(x[0]) for x in part))
        want = [lost(x, bits) for x in part]
        assert r.n_nulls == sum(x is None for w in want for x in w)
        if all(x[0] != 701 for x in part):
            assert r.rows_sha256 == sha("\n".join(map(said, want)))
        start = [c for c in NAMES if not (bits & 4 and c in ("nation_id", "segment"))]
        start = start[:1] + start[:0:-1] if bits & 2 else start
        swap = {"name": "email", "email": "name"} if bits & 1 else {}
        assert r.start_columns == ",".join(swap.get(c, c) for c in start)
        file = pq.ParquetFile(r.path.removeprefix("file://"))
        assert file.schema_arrow.equals(migrate.CLIENTS) and [migrate.field_id(f) for f in file.schema_arrow] == list(range(1, 11))
    assert kinds == set(range(16))
    folder = os.path.dirname(got[0].path.removeprefix("file://"))
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(r.path) for r in got.values())
    # a folder for each call
    again = migrate.rewritten_clients(spark, df).first().path
    assert os.path.dirname(again.removeprefix("file://")) != folder


def test_no_clients(spark):
    assert migrate.rewritten_clients(spark, spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("bits", range(16))
def test_chain_of_every_drift(bits):
    schema, places = migrate.drifted(migrate.CLIENTS, bits)
    assert migrate.drift(schema, migrate.CLIENTS) == bits
    plan = migrate.chain(schema, migrate.CLIENTS, migrate.DEFAULTS)
    assert (plan is None) == (bits == 0)
    table = rows(20)
    columns = [pa.array([r[k] for r in table], migrate.CLIENTS.field(k).type).cast(f.type) for k, f in zip(places, schema, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, schema=schema)
    if plan:
        made = migrate.migrated(batch, plan, migrate.CLIENTS)
        assert made.schema.equals(migrate.CLIENTS, check_metadata=True)
        assert list(map(repr, zip(*(c.to_pylist() for c in made.columns), strict=True))) == [repr(lost(r, bits)) for r in table]
        assert migrate.migrated(batch.slice(0, 0), plan, migrate.CLIENTS).num_rows == 0


def test_transforms_compose_in_any_order():
    schema, _ = migrate.drifted(migrate.CLIENTS, 15)
    plan = migrate.plan_of(schema)
    ways = [[migrate.add, migrate.reorder, migrate.widen, migrate.rename], [migrate.rename, migrate.widen, migrate.add, migrate.reorder]]
    made = []
    for way in ways:
        p = plan
        for transform in way:
            p = transform(p, migrate.CLIENTS, migrate.DEFAULTS)
        made.append(p)
    assert made[0] == made[1] == migrate.chain(schema, migrate.CLIENTS, migrate.DEFAULTS)


def field(name, kind, number):
    return pa.field(name, kind, metadata={migrate.FIELD_ID: str(number).encode()})


def test_other_drifts():
    target = pa.schema([field("a", pa.int64(), 1), field("b", pa.string(), 2)])
    extra = pa.schema([field("a", pa.int64(), 1), field("x", pa.string(), 9), field("b", pa.string(), 2)])
    assert migrate.drift(extra, target) == migrate.REORDER
    batch = pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array(["u", "v"]), pa.array(["p", None])], schema=extra)
    assert migrate.migrated(batch, migrate.chain(extra, target, {}), target).to_pylist() == [{"a": 1, "b": "p"}, {"a": None, "b": None}]
    with pytest.raises(ValueError, match="widen"):
        migrate.chain(pa.schema([field("a", pa.string(), 1), field("b", pa.string(), 2)]), target, {})
    with pytest.raises(ValueError, match="twice"):
        migrate.drift(pa.schema([field("a", pa.int64(), 1), field("b", pa.string(), 1)]), target)
    with pytest.raises(ValueError, match="no id"):
        migrate.drift(pa.schema([pa.field("a", pa.int64())]), target)


def test_written_whole_or_not_at_all(tmp_path):
    schema = pa.schema([field("a", pa.int64(), 1)])

    def broken():
        yield pa.RecordBatch.from_arrays([pa.array([1])], schema=schema)
        raise OSError("lost")

    path, spare = str(tmp_path / "table" / "f.parquet"), str(tmp_path / "spare")
    with pytest.raises(OSError, match="lost"):
        migrate.written(broken(), schema, path, spare)
    assert os.listdir(tmp_path / "table") == []
    for _ in range(2):  # a task that runs again
        migrate.written(iter([pa.RecordBatch.from_arrays([pa.array([2])], schema=schema)]), schema, path, spare)
    assert os.listdir(tmp_path / "table") == ["f.parquet"] and pq.read_table(path).to_pylist() == [{"a": 2}]


def test_old_files_stay_until_all_are_done(spark, tmp_path):
    # one file cannot be rewritten: no old file is lost
    good, _ = migrate.drifted(migrate.CLIENTS, 1)
    bad = migrate.CLIENTS.set(0, field("client_id", pa.string(), 1))
    for name, schema in (("file-00000", good), ("file-00001", bad)):
        migrate.written(iter([]), schema, str(tmp_path / "table" / f"{name}.parquet"), str(tmp_path / "spare"))
    with pytest.raises(Exception, match="widen"):
        migrate.rewrite(migrate.files_of(spark, str(tmp_path / "table")), migrate.CLIENTS, migrate.DEFAULTS, str(tmp_path / "spare"))
    assert {"file-00000.parquet", "file-00001.parquet"} <= set(os.listdir(tmp_path / "table"))
