"""Data sources for binary files of fixed-size records: raw ones of any layout, and states of bodies.

``spark.read.format("tessera_records")`` reads files that hold nothing but records, little-endian and unpadded, whose
fields the option ``layout`` names: ``"id:i8, x:f8[3], flag:u1"``. ``tessera_states`` reads and writes states of bodies,
with sizes and state numbers in the file. Both cut files into partitions by offsets, so that one file of any length is
read by many tasks, and both write from the tasks: each attempt writes a file of its own beside the target, the commit
moves those of the attempts that count and deletes the others. No record passes the driver.

Files are reached through ``pyarrow.fs``: paths without a scheme, ``file://`` and the stores that it knows. Register with
``register(spark)``.

A state file: header (magic ``TSS2``, bodies, nq, nu, length of the simulation's name, name), then per state its number,
its time and per body id, q and u, and a footer (first and last state number, states, magic). Numbers ascend in a file.
Where ``spark.sql.python.filterPushdown.enabled`` is set, ``read_states`` (or the option ``pushdown``) lets filters on
``state_nr`` narrow the ranges that are read, and filters on ``body_id`` drop bodies before they are handed over.
"""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

#: Bytes of a partition, and of what is read and handed over at once.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20

# How types are written in a layout.
TYPES = {"i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "f4": "float", "f8": "double"}

_MAGIC = b"TSS2"
_HEAD, _STATE, _FOOT = "<4sQIII", "<qd", "<qqQ4s"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the data files at ``path``, which may name a folder or a file; hidden ones are left out."""
    from pyarrow import fs

    store, base = _store(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file]
    hidden = lambda p: any(x[:1] in "._" for x in p[len(base) :].split("/") if x)
    return sorted((i.path, i.size) for i in found if not hidden(i.path))


class _Output:
    """Files of a write's tasks: written aside, moved on commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.aside = path.rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def open(self, name: str):
        store, base = _store(self.path)
        store.create_dir(f"{base}/{self.aside}", recursive=True)
        return store.open_output_stream(f"{base}/{self.aside}/{name}")

    def commit(self, names: list[str]) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        old = [p for p, _ in _files(self.path)] if self.overwrite else []
        for name in names:
            store.move(f"{base}/{self.aside}/{name}", f"{base}/{name}")
        for p in old:
            store.delete_file(p)
        self.abort()

    def abort(self) -> None:
        from pyarrow import fs

        store, base = _store(self.path)
        if store.get_file_info(f"{base}/{self.aside}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.aside}")


@dataclass
class Written(D.WriterCommitMessage):
    names: list[str]


class _Writer(D.DataSourceArrowWriter):
    """Writes the files that ``write`` opens; their names go to the commit."""

    def __init__(self, options, overwrite: bool):
        self.out = _Output(options["path"], overwrite)

    def commit(self, messages) -> None:
        self.out.commit([n for m in messages if m for n in m.names])

    def abort(self, messages) -> None:
        self.out.abort()


@dataclass
class Range(D.InputPartition):
    """Records ``low`` to before ``high`` of a file."""

    path: str
    low: int
    high: int

    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def _ranges(path: str, low: int, high: int, size: int, options) -> list[Range]:
    step = max(1, int(options.get("partitionBytes", PARTITION_BYTES)) // size)
    return [Range(path, k, min(k + step, high)) for k in range(low, high, step)]


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1)))


# --- Records of any layout


def record_type(layout: str) -> np.dtype:
    fields = []
    for part in layout.split(","):
        found = re.fullmatch(r"\s*(\w+)\s*:\s*(\w\d)\s*(?:\[(\d+)\])?\s*", part)
        if not found or found[2] not in TYPES:
            raise ValueError(f"a layout has no field like {part.strip()!r}")
        fields.append((found[1], "<" + found[2], (int(found[3]),)) if found[3] else (found[1], "<" + found[2]))
    return np.dtype(fields)


def record_schema(layout: str) -> str:
    kind = record_type(layout)
    of = lambda f: f"array<{TYPES[f.base.str[1:]]}>" if f.shape else TYPES[f.base.str[1:]]
    return ", ".join([f"{n} {of(kind[n])}" for n in kind.names] + ["file string", "record bigint"])


class Records(D.DataSource):
    """Option ``layout``; ``skip``: bytes before the first record. Columns: the fields, then file and record (from 0)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_records"

    def schema(self) -> str:
        return record_schema(self.options["layout"])

    def reader(self, schema):
        return _RecordReader(self.options)

    def writer(self, schema, overwrite):
        return _RecordWriter(self.options, overwrite)


class _RecordReader(D.DataSourceReader):
    def __init__(self, options):
        self.options, self.kind, self.skip = options, record_type(options["layout"]), int(options.get("skip", 0))

    def partitions(self):
        out = []
        for path, size in _files(self.options["path"]):
            records, rest = divmod(size - self.skip, self.kind.itemsize)
            if rest or size < self.skip:
                raise ValueError(f"{path} ends inside a record")
            out += _ranges(path, 0, records, self.kind.itemsize, self.options)
        return out

    def read(self, part):
        if part is None:
            return
        step = max(1, BATCH_BYTES // self.kind.itemsize)
        with _store(self.options["path"])[0].open_input_file(part.path) as f:
            for low in range(part.low, part.high, step):
                n = min(step, part.high - low)
                f.seek(self.skip + low * self.kind.itemsize)
                rows = np.frombuffer(f.read(n * self.kind.itemsize), self.kind)
                columns = [self._column(rows[c]) for c in self.kind.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([part.path] * n), pa.array(np.arange(low, low + n))], [*self.kind.names, "file", "record"])

    @staticmethod
    def _column(values: np.ndarray) -> pa.Array:
        wider = {"u1": np.int16, "u2": np.int32, "u4": np.int64}.get(values.dtype.str[1:])
        values = values.astype(wider) if wider else values
        return _lists(values) if values.ndim > 1 else pa.array(np.ascontiguousarray(values))


class _RecordWriter(_Writer):
    def __init__(self, options, overwrite):
        super().__init__(options, overwrite)
        self.kind = record_type(options["layout"])

    def write(self, iterator):
        name = f"part-{uuid.uuid4().hex}.bin"
        with self.out.open(name) as f:
            for batch in iterator:
                rows = np.zeros(batch.num_rows, self.kind)
                for c in self.kind.names:
                    column = batch.column(batch.schema.get_field_index(c))
                    shape = self.kind[c].shape
                    if column.null_count or (shape and (column.flatten().null_count or (np.diff(column.offsets.to_numpy()) != shape[0]).any())):
                        raise ValueError(f"{c} is null or has another length than its layout says")
                    values = column.flatten().to_numpy().reshape(-1, *shape) if shape else column.to_numpy(zero_copy_only=False)
                    rows[c] = values
                    if self.kind[c].base.kind in "iu" and (rows[c] != values).any():
                        raise ValueError(f"a value of {c} doesn't fit its layout")
                f.write(rows.tobytes())
        return Written([name])


# --- States


def state_schema() -> str:
    return "sim_id string, state_nr bigint, t double, body_id bigint, q array<double>, u array<double>"


class States(D.DataSource):
    """Writing needs the options ``nq`` and ``nu`` where they aren't 7 and 6; use ``write_states``, which brings rows in order."""

    @classmethod
    def name(cls) -> str:
        return "tessera_states"

    def schema(self) -> str:
        return state_schema()

    def reader(self, schema):
        return (_PushingReader if self.options.get("pushdown") == "true" else _StateReader)(self.options)

    def writer(self, schema, overwrite):
        return _StateWriter(self.options, overwrite)


@dataclass
class _Head:
    sim_id: str
    bodies: int
    nq: int
    nu: int
    start: int
    first: int
    last: int
    states: int

    @property
    def body(self) -> np.dtype:
        return np.dtype([("id", "<i8"), ("v", "<f8", (self.nq + self.nu,))])

    @property
    def size(self) -> int:
        """Bytes of a state."""
        return struct.calcsize(_STATE) + self.bodies * self.body.itemsize


def _head(f, path: str, size: int) -> _Head:
    f.seek(0)
    raw = f.read(struct.calcsize(_HEAD))
    magic, bodies, nq, nu, n = struct.unpack(_HEAD, raw) if len(raw) == struct.calcsize(_HEAD) else (b"", 0, 0, 0, 0)
    if magic != _MAGIC or size < struct.calcsize(_HEAD) + n + struct.calcsize(_FOOT):
        raise ValueError(f"{path} is no state file")
    sim_id = f.read(n).decode()
    f.seek(size - struct.calcsize(_FOOT))
    first, last, states, end = struct.unpack(_FOOT, f.read(struct.calcsize(_FOOT)))
    head = _Head(sim_id, bodies, nq, nu, struct.calcsize(_HEAD) + n, first, last, states)
    if end != _MAGIC or head.start + states * head.size + struct.calcsize(_FOOT) != size:
        raise ValueError(f"{path} is cut short")
    return head


class _StateReader(D.DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.low, self.high = (int(options[k]) if k in options else None for k in ("fromState", "toState"))
        self.bodies: set[int] | None = None
        self.body_low = self.body_high = None

    def partitions(self):
        out = []
        store = _store(self.options["path"])[0]
        for path, size in _files(self.options["path"]):
            with store.open_input_file(path) as f:
                head = _head(f, path, size)
                if (want := self.options.get("nq")) and int(want) != head.nq or (want := self.options.get("nu")) and int(want) != head.nu:
                    raise ValueError(f"{path} has another layout")
                low = 0 if self.low is None or self.low <= head.first else self._place(f, head, self.low)
                high = head.states if self.high is None or self.high >= head.last else self._place(f, head, self.high + 1)
            # Rows are numbered over states and bodies: a range may begin and end inside a state.
            out += _ranges(path, low * head.bodies, high * head.bodies, head.body.itemsize, self.options)
        return out

    @staticmethod
    def _place(f, head: _Head, number: int) -> int:
        """The first state whose number reaches ``number``."""
        low, high = 0, head.states
        while low < high:
            middle = (low + high) // 2
            f.seek(head.start + middle * head.size)
            if struct.unpack(_STATE, f.read(struct.calcsize(_STATE)))[0] < number:
                low = middle + 1
            else:
                high = middle
        return low

    def read(self, part):
        if part is None:  # no partition at all
            return
        store = _store(self.options["path"])[0]
        with store.open_input_file(part.path) as f:
            head = _head(f, part.path, f.size())
            whole = np.dtype([("number", "<i8"), ("t", "<f8"), ("bodies", head.body, (head.bodies,))])
            many, row = max(1, BATCH_BYTES // head.size), part.low
            while row < part.high:
                state, inside = divmod(row, head.bodies)
                n = min(many, (part.high - row) // head.bodies)
                at = head.start + state * head.size
                if not inside and n and head.size <= BATCH_BYTES:
                    f.seek(at)
                    states = np.frombuffer(f.read(n * head.size), whole)
                    yield from self._batch(head, np.repeat(states["number"], head.bodies), np.repeat(states["t"], head.bodies), states["bodies"].reshape(-1))
                    row += n * head.bodies
                    continue
                n = min(head.bodies - inside, part.high - row, max(1, BATCH_BYTES // head.body.itemsize))
                f.seek(at)
                number, t = struct.unpack(_STATE, f.read(struct.calcsize(_STATE)))
                f.seek(at + struct.calcsize(_STATE) + inside * head.body.itemsize)
                yield from self._batch(head, np.full(n, number), np.full(n, t), np.frombuffer(f.read(n * head.body.itemsize), head.body))
                row += n

    def _batch(self, head: _Head, number, t, bodies) -> Iterator[pa.RecordBatch]:
        ids, keep = bodies["id"], None
        for bound, test in ((self.body_low, np.greater_equal), (self.body_high, np.less_equal)):
            if bound is not None:
                keep = test(ids, bound) if keep is None else keep & test(ids, bound)
        if self.bodies is not None:
            within = np.isin(ids, np.array(sorted(self.bodies), np.int64))
            keep = within if keep is None else keep & within
        if keep is not None:
            number, t, bodies, ids = number[keep], t[keep], bodies[keep], ids[keep]
        if len(ids):
            v = bodies["v"]
            columns = [pa.array([head.sim_id] * len(ids)), pa.array(number), pa.array(t), pa.array(np.ascontiguousarray(ids)), _lists(v[:, : head.nq]), _lists(v[:, head.nq :])]
            yield pa.RecordBatch.from_arrays(columns, ["sim_id", "state_nr", "t", "body_id", "q", "u"])


class _PushingReader(_StateReader):
    """Apart, as Spark refuses a reader that takes filters while it pushes none."""

    def pushFilters(self, filters):
        """Bounds and sets on state_nr and body_id are met here; all else stays with Spark."""
        steps = {D.GreaterThan: (1, None), D.GreaterThanOrEqual: (0, None), D.LessThan: (None, -1), D.LessThanOrEqual: (None, 0), D.EqualTo: (0, 0)}
        narrower = lambda f, a, b: b if a is None else a if b is None else f(a, b)
        for x in filters:
            column = getattr(x, "attribute", None)
            if isinstance(x, D.In) and column == ("body_id",):
                wanted = {v for v in x.value if v is not None}
                self.bodies = wanted if self.bodies is None else self.bodies & wanted
            elif type(x) in steps and column in (("state_nr",), ("body_id",)) and isinstance(x.value, int):
                up, down = steps[type(x)]
                low, high = None if up is None else x.value + up, None if down is None else x.value + down
                if column == ("state_nr",):
                    self.low, self.high = narrower(max, self.low, low), narrower(min, self.high, high)
                else:
                    self.body_low, self.body_high = narrower(max, self.body_low, low), narrower(min, self.body_high, high)
            elif not (isinstance(x, D.IsNotNull) and column in (("state_nr",), ("body_id",))):
                yield x


class _StateWriter(_Writer):
    def __init__(self, options, overwrite):
        super().__init__(options, overwrite)
        self.nq, self.nu = int(options.get("nq", 7)), int(options.get("nu", 6))

    def write(self, iterator):
        out = _StateFiles(self)
        for batch in iterator:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sizes = [(columns[c], n) for c, n in (("q", self.nq), ("u", self.nu))]
            if any(columns[c].null_count for c in ("sim_id", "state_nr", "t", "body_id")) or any(c.null_count or c.flatten().null_count or (np.diff(c.offsets.to_numpy()) != n).any() for c, n in sizes):
                raise ValueError("a state has another layout")
            ids, number, t = (columns[c].to_numpy() for c in ("body_id", "state_nr", "t"))
            v = np.hstack([c.flatten().to_numpy().reshape(-1, n) for c, n in sizes])
            sims = columns["sim_id"].to_pylist()
            new = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | np.array([a != b for a, b in zip(sims[1:], sims)], bool))[: len(ids)]).tolist()
            for low, high in zip(new, [*new[1:], len(ids)]):
                out.add(sims[low], int(number[low]), t[low:high], ids[low:high], v[low:high])
        return Written(out.close())


class _StateFiles:
    """A file for each simulation of a task. Bodies are written as they come, none are held.

    How many bodies a state has stands in the head of its file: the first state waits on the task's own disk until it is known.
    """

    def __init__(self, writer: _StateWriter):
        self.writer, self.names, self.key = writer, [], None
        self.file, self.waiting, self.sim_id, self.bodies, self.first, self.last, self.states = None, None, None, None, None, None, 0

    def add(self, sim_id: str, number: int, t: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        if self.key != (sim_id, number):
            self._end_state()
            self._begin_state(sim_id, number, float(t[0]))
        if (t != self.t).any() or (np.diff(ids) <= 0).any() or (self.count and ids[0] <= self.last_id):
            self._refuse()
        rows = np.zeros(len(ids), np.dtype([("id", "<i8"), ("v", "<f8", (v.shape[1],))]))
        rows["id"], rows["v"] = ids, v
        (self.waiting or self.file).write(rows.tobytes())
        self.count, self.last_id = self.count + len(ids), ids[-1]

    def _refuse(self) -> None:
        raise ValueError(f"state {self.key[1]} of {self.key[0]} has other bodies, bodies out of order or several times")

    def _begin_state(self, sim_id: str, number: int, t: float) -> None:
        if sim_id != self.sim_id:
            self._end()
            self.names.append(f"part-{uuid.uuid4().hex}.tss")
            self.file, self.waiting = self.writer.out.open(self.names[-1]), tempfile.TemporaryFile()
            self.sim_id, self.bodies, self.first, self.states = sim_id, None, number, 0
        elif number <= self.last:
            raise ValueError(f"state {number} of {sim_id} comes out of order")
        self.key, self.t, self.count, self.last_id = (sim_id, number), t, 0, None
        (self.waiting or self.file).write(struct.pack(_STATE, number, t))

    def _end_state(self) -> None:
        if self.key is None:
            return
        if self.waiting is not None:
            self.bodies, name = self.count, self.sim_id.encode()
            self.file.write(struct.pack(_HEAD, _MAGIC, self.bodies, self.writer.nq, self.writer.nu, len(name)) + name)
            self.waiting.seek(0)
            while block := self.waiting.read(BATCH_BYTES):
                self.file.write(block)
            self.waiting.close()
            self.waiting = None
        elif self.count != self.bodies:
            self._refuse()
        self.last, self.states, self.key = self.key[1], self.states + 1, None

    def _end(self) -> None:
        if self.file is not None:
            self.file.write(struct.pack(_FOOT, self.first, self.last, self.states, _MAGIC))
            self.file.close()
            self.file = None

    def close(self) -> list[str]:
        self._end_state()
        self._end()
        return self.names


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)
    spark.dataSource.register(States)


def write_states(states: DataFrame, path: str, mode: str = "append", nq: int = 7, nu: int = 6, partitions: int | None = None) -> None:
    """Writes states; those of one number stay together, in files whose numbers ascend. A state is the unit that one task writes."""
    register(states.sparkSession)
    n = [partitions] if partitions else []
    rows = states.select("sim_id", F.col("state_nr").cast("long"), F.col("t").cast("double"), F.col("body_id").cast("long"), F.col("q").cast("array<double>"), F.col("u").cast("array<double>"))
    ordered = rows.repartitionByRange(*n, "sim_id", "state_nr").sortWithinPartitions("sim_id", "state_nr", "body_id")
    ordered.write.format("tessera_states").mode(mode).option("nq", nq).option("nu", nu).save(path)


def read_states(spark: SparkSession, path: str, **options) -> DataFrame:
    """Options: nq and nu (another layout fails), fromState, toState, partitionBytes."""
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("tessera_states").options(**{"pushdown": pushdown, **options}).load(path)


def write_records(rows: DataFrame, path: str, layout: str, mode: str = "append") -> None:
    """Writes the fields of ``layout`` as records, in the order that each partition has."""
    register(rows.sparkSession)
    kind = record_type(layout)
    fields = dict(x.split(" ", 1) for x in record_schema(layout).split(", "))
    rows.select(*(F.col(c).cast(fields[c]) for c in kind.names)).write.format("tessera_records").mode(mode).option("layout", layout).save(path)


def read_records(spark: SparkSession, path: str, layout: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("tessera_records").options(layout=layout, **options).load(path)
