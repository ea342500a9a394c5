"""User-defined sources and sinks on Spark's Python Data Source API.

A source is a function that opens one file and yields Arrow batches; a sink is a function that saves
the batches of one task to one file. Spark plans the partitions, ships the functions and retries the
tasks; files are reached through Arrow's filesystem layer, so paths may be on shared storage.
"""

from __future__ import annotations

import inspect
import json
import sys
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType


# The functions of this package travel to the workers whole, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules["millrace"])

OpenFile = Callable[..., Iterator[pa.RecordBatch]]
SaveFile = Callable[[Iterator[pa.RecordBatch], object], None]


def filesystem(path: str):
    """Arrow filesystem and path for a URI or a plain local path."""
    uri = arrow_uri(path)
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


def arrow_uri(path: str) -> str:
    """Clusters call S3 storage ``s3a`` or ``s3n``, Arrow calls it ``s3``."""
    scheme, colon, rest = path.partition("://")
    return f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else path


def _unimplemented(*_):
    raise NotImplementedError("this custom format has no function for that direction")


@dataclass
class _Saved(WriterCommitMessage):
    """A file that a task wrote: its name below the target, pieces, and the range of values of each column."""

    file: str | None
    pieces: int = 1
    ranges: dict | None = None


def _one_piece(_: object) -> int:
    return 1


#: Names that ``register_format`` has made known, which sinks accept as formats.
REGISTERED: set[str] = set()
PUBLISHED = "_published"
#: Of files that no write of ours has described, so many are opened by the driver to count their pieces; of more, tasks take shares.
COUNTED_FILES = 256
SHARE_BYTES = 64 << 20


def _numbers(system, root: str) -> list[int]:
    if system.get_file_info(f"{root}/{PUBLISHED}").type != fs.FileType.Directory:
        return []
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/{PUBLISHED}"))]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _load(system, root: str, number: int) -> dict:
    with system.open_input_stream(f"{root}/{PUBLISHED}/{number}.json") as stream:
        return json.loads(stream.read())


def _published(system, root: str) -> list[dict] | None:
    """The files of the last published state, or None where none was published."""
    numbers = _numbers(system, root)
    if not numbers:
        return None
    files, number = [], numbers[-1]
    while number is not None:
        content = _load(system, root, number)
        files, number = content["files"] + files, content["after"]
    return files


def _forget(system, root: str, numbers: list[int]) -> None:
    """After an overwrite: delete what was published before the state it replaces, which readers may still hold."""
    if not numbers:
        return
    held, number = set(), numbers[-1]
    while number is not None:
        held.add(number)
        number = _load(system, root, number)["after"]
    for number in set(numbers) - held:
        for folder in {f["file"].split("/")[0] for f in _load(system, root, number)["files"]}:
            if system.get_file_info(f"{root}/{folder}").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/{folder}")
        system.delete_file(f"{root}/{PUBLISHED}/{number}.json")


def _widen(ranges: dict, batch: pa.RecordBatch) -> None:
    """Least and largest value of each column of whole numbers, fractions or short texts, over all batches; None where unknown."""
    for name, column in zip(batch.schema.names, batch.columns):
        kind = column.type
        if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind)) or ranges.get(name, ()) is None:
            continue
        least, most = (pc.min_max(column)[k].as_py() for k in ("min", "max"))
        if pa.types.is_floating(kind) and len(column) and pc.any(pc.is_nan(column)).as_py():
            ranges[name] = None  # NaN is above all numbers in Spark and has no place in a range
            continue
        if isinstance(most, str) and len(most) + len(least) > 200:
            ranges[name] = None
            continue
        if least is None:
            ranges.setdefault(name, [])
        elif ranges.get(name):
            ranges[name] = [min(ranges[name][0], least), max(ranges[name][1], most)]
        else:
            ranges[name] = [least, most]


def _comparison(pushed) -> tuple | None:
    """A pushed filter as ``(column, operator, value)``, if it compares a top-level column with values."""
    operators = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
    operator = operators.get(type(pushed))
    if operator is None or len(pushed.attribute) != 1:
        return None
    return pushed.attribute[0], operator, pushed.value


def _in_range(ranges: dict | None, filters: list) -> bool:
    """Whether a file with these ranges may hold rows for all filters. An empty range has NULL only, which meets no comparison."""
    for column, operator, value in filters:
        known = (ranges or {}).get(column)
        if known is None:
            continue
        if not known:
            return False
        least, most = known
        tests = {"=": lambda v: least <= v <= most, ">": lambda v: most > v, ">=": lambda v: most >= v, "<": lambda v: least < v, "<=": lambda v: least <= v}
        try:
            fits = any(least <= v <= most for v in value if v is not None) if operator == "in" else tests[operator](value)
        except TypeError:  # values of kinds that do not compare
            continue
        if not fits:
            return False
    return True


def register_format(
    spark: SparkSession,
    name: str,
    schema: str,
    open_file: OpenFile = _unimplemented,
    save_file: SaveFile = _unimplemented,
    count_pieces: Callable[[object], int] = _one_piece,
    suffix: str = "",
    may_hold: Callable[[object, int, list], bool] | None = None,
) -> None:
    """Make ``spark.read.format(name)`` and ``df.write.format(name)`` work.

    ``open_file(stream, piece)`` yields the record batches of one piece of an open file;
    ``count_pieces(stream)`` says how many pieces a file has; ``save_file(batches, stream)`` writes.

    The option ``columns`` names the columns to read, separated by commas: Spark does not tell a format written in
    Python which ones a query uses. An ``open_file`` with a third parameter gets them as a list and
    can leave the others unread; for one without, they are dropped afterwards.

    A write puts its files below a folder of its own and is published by one small file that names them, with the pieces
    and ranges of values of each. So an overwrite leaves the old state readable until it is complete, and readers skip files by
    the filters that Spark hands on (``spark.sql.python.filterPushdown.enabled``). With ``may_hold(stream, piece, filters)`` a format
    can tell from its own statistics whether a piece may hold rows for all of the ``(column, operator, value)`` filters; others
    are not read. Spark applies the filters again, so both may say yes too often.
    """
    takes_columns = open_file is not _unimplemented and len(inspect.signature(open_file).parameters) > 2
    declared = StructType.fromDDL(schema)

    def chosen(options) -> list[str]:
        wanted = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
        missing = set(wanted) - set(declared.names)
        if missing:
            raise ValueError(f"no columns {sorted(missing)} in the format {name!r}")
        return wanted or declared.names

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path = options["path"]
            self.columns = chosen(options)
            self.filters = []

        def pushFilters(self, filters):
            self.filters = [f for f in map(_comparison, filters) if f]
            return filters

        def partitions(self):
            system, root = filesystem(self.path)
            info = system.get_file_info(root)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            published = None if info.is_file else _published(system, root)
            if published is not None:
                kept = [f for f in published if _in_range(f["ranges"], self.filters)]
                return [InputPartition((f"{root}/{f['file']}", piece, 1)) for f in kept for piece in range(f["pieces"])]
            files = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
            shown = (f for f in files if f.is_file and not f.base_name.startswith(("_", ".")) and f.path.endswith(suffix))
            found = sorted((f.path, f.size) for f in shown)
            if count_pieces is _one_piece:
                return [InputPartition((path, 0, 1)) for path, _ in found]
            if len(found) > COUNTED_FILES:  # a task goes through every n-th piece of its file
                shares = [(path, max(1, -(-size // SHARE_BYTES))) for path, size in found]
                return [InputPartition((path, i, n)) for path, n in shares for i in range(n)]

            def pieces(path):
                with system.open_input_file(path) as stream:
                    return [InputPartition((path, i, 1)) for i in range(count_pieces(stream))]

            # Opening a file is mostly waiting for the storage.
            with ThreadPoolExecutor(32) as pool:
                return [piece for some in pool.map(pieces, [path for path, _ in found]) for piece in some]

        def read(self, partition):
            if partition is None:  # an empty folder
                return
            path, piece, shares = partition.value
            system, _ = filesystem(self.path)
            with system.open_input_file(path) as stream:
                wanted = [piece] if shares == 1 else range(piece, count_pieces(stream), shares)
                for one in wanted:
                    stream.seek(0)
                    if may_hold is not None and self.filters and not may_hold(stream, one, self.filters):
                        continue
                    stream.seek(0)
                    if takes_columns:
                        yield from open_file(stream, one, self.columns)
                    else:
                        for batch in open_file(stream, one):
                            yield batch.select(self.columns)

    class Writer(DataSourceArrowWriter):
        def __init__(self, options, overwrite):
            self.path = options["path"]
            self.overwrite = overwrite
            self.job = uuid.uuid4().hex[:12]

        def write(self, iterator):
            system, root = filesystem(self.path)
            first = next(iterator, None)
            if first is None:
                return _Saved(None)
            # Unseen until the job names it; a retried task writes another file, never this one.
            file = f"job={self.job}/part-{uuid.uuid4().hex}{suffix}"
            system.create_dir(f"{root}/job={self.job}", recursive=True)
            ranges: dict = {}

            def batches():
                for batch in chain([first], iterator):
                    _widen(ranges, batch)
                    yield batch

            with system.open_output_stream(f"{root}/{file}") as stream:
                save_file(batches(), stream)
            if count_pieces is _one_piece:
                return _Saved(file, 1, ranges)
            with system.open_input_file(f"{root}/{file}") as stream:
                return _Saved(file, count_pieces(stream), ranges)

        def commit(self, messages):
            system, root = filesystem(self.path)
            system.create_dir(f"{root}/{PUBLISHED}", recursive=True)
            numbers = _numbers(system, root)
            files = [m.__dict__ for m in messages if m is not None and m.file]
            content = {"after": numbers[-1] if numbers and not self.overwrite else None, "files": files}
            number = numbers[-1] + 1 if numbers else 0
            with system.open_output_stream(f"{root}/{PUBLISHED}/.{number}") as stream:
                stream.write(json.dumps(content).encode())
            system.move(f"{root}/{PUBLISHED}/.{number}", f"{root}/{PUBLISHED}/{number}.json")
            with system.open_output_stream(f"{root}/_SUCCESS"):
                pass
            if self.overwrite:
                _forget(system, root, numbers)

        def abort(self, messages):
            system, root = filesystem(self.path)
            if system.get_file_info(f"{root}/job={self.job}").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/job={self.job}")

    class CustomFormat(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return StructType([declared[c] for c in chosen(self.options)])

        def reader(self, schema):
            return Reader(self.options)

        def writer(self, schema, overwrite):
            return Writer(self.options, overwrite)

    spark.dataSource.register(CustomFormat)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    REGISTERED.add(name)
