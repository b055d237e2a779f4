"""Folders of recordings' files as a data source, to be read whole or as a stream of a growing folder.

A row is a dataset: (path, dataset, shape, values, texts), values in row-major order, as ``containers`` takes them.  Files: arrays
(``.npy``: one, named by the file; ``.npz``: several), pickled arrays or dictionaries of arrays (``.pkl``; nothing else is
unpickled), headers (``.ini``, ``.smh``: one row ``header`` with ``texts``), and HDF5 (``.h5``, where h5py is installed on the workers).

Files are dealt to partitions by their bytes.  Filters on ``path`` and ``dataset`` reach the reader, so that other files are
not opened and other arrays not decoded, if ``spark.sql.python.filterPushdown.enabled`` is set; a schema given to the reader leaves out the columns that it lacks.
Paths are opened by pyarrow's file systems, so a shared folder may be local, or in any store that these reach.
"""

from __future__ import annotations

import io
import pickle
import time
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "path string, dataset string, shape array<bigint>, values array<double>, texts map<string,string>"
KINDS = (".npy", ".npz", ".pkl", ".ini", ".smh", ".h5")
#: What a pickled array is made of; nothing else is looked up.
HARMLESS = {("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode"), *((m, f) for m in ("numpy.core.multiarray", "numpy._core.multiarray", "numpy.core.numeric", "numpy._core.numeric") for f in ("_reconstruct", "scalar", "_frombuffer"))}


class _Arrays(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in HARMLESS:
            raise pickle.UnpicklingError(f"a file of arrays does not hold {module}.{name}")
        return super().find_class(module, name)


def listed(folder: str, kinds: tuple[str, ...]) -> list[tuple[float, str, int]]:
    """(time of change, path, bytes) of the folder's files of these kinds, in this order; hidden ones and those below hidden folders are left out."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    prefix = folder.rstrip("/")[: len(folder.rstrip("/")) - len(root.rstrip("/"))] if "://" in folder else ""
    ok = [f for f in found if f.is_file and f.path.endswith(kinds) and not any(p[:1] in ("_", ".") for p in f.path[len(root) :].split("/"))]
    return sorted((f.mtime.timestamp(), prefix + f.path, f.size) for f in ok)


def opened(path: str) -> bytes:
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(p) as f:
        return f.read()


def header(text: str) -> dict[str, str]:
    """Lines ``prefix_key = value``; the key is what follows the first ``_``, the last line of a key wins."""
    out = {}
    for line in text.splitlines():
        if line[:1] not in ("", ";", "#", "[") and "=" in line:
            key, value = line.split("=", 1)
            out[key.strip().split("_", 1)[-1].strip()] = value.strip()
    return out


def datasets(path: str, wanted) -> Iterator[tuple[str, object]]:
    """(name, array or dictionary of texts) of a file's datasets whose names ``wanted`` holds for."""
    stem, kind = path.rsplit("/", 1)[-1].rsplit(".", 1)
    if kind == "npy":
        if wanted(stem):
            yield stem, np.load(io.BytesIO(opened(path)), allow_pickle=False)
    elif kind == "npz":
        with np.load(io.BytesIO(opened(path)), allow_pickle=False) as z:
            yield from ((n, z[n]) for n in z.files if wanted(n))  # arrays are decoded one by one
    elif kind == "pkl":
        found = _Arrays(io.BytesIO(opened(path))).load()
        found = found if isinstance(found, dict) else {"rois": found}
        yield from ((str(n), np.asarray(a)) for n, a in found.items() if wanted(str(n)))
    elif kind in ("ini", "smh"):
        if wanted("header"):
            yield "header", header(opened(path).decode("utf-8", "replace"))
    else:
        try:
            import h5py
        except ImportError as e:
            raise ImportError(f"{path} needs h5py on the workers") from e
        with h5py.File(io.BytesIO(opened(path))) as f:
            yield from ((n, f[n][()]) for n in f if wanted(n) and isinstance(f[n], h5py.Dataset) and np.issubdtype(f[n].dtype, np.number))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def dealt(files: list[tuple[float, str, int]], size: int) -> list[Files]:
    """Files to partitions of about ``size`` bytes."""
    out, held = [], size
    for _, path, n in files:
        if held + n > size and (held or not out):
            out.append([])
            held = 0
        out[-1].append(path)
        held += n
    return [Files(p) for p in out] or [Files([])]


class _Reads:
    def __init__(self, options: dict, columns: list[str]):
        if "path" not in options:
            raise ValueError("a folder is wanted: option path")
        self.folder, self.columns = options["path"], columns
        self.kinds = tuple(k if k.startswith(".") else f".{k}" for k in options["kinds"].split(",")) if options.get("kinds") else KINDS
        self.size = int(options.get("bytes", 64 << 20))
        self.names = set(options["datasets"].split(",")) if options.get("datasets") else None
        self.starts: list[str] = []
        self.paths: set[str] | None = None

    def wanted(self, name: str) -> bool:
        return (self.names is None or name in self.names) and all(name.startswith(s) for s in self.starts)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            for name, what in datasets(path, self.wanted):
                texts = what if isinstance(what, dict) else None
                row = {"path": path, "dataset": name, "shape": None if texts is not None else list(np.shape(what)), "texts": texts}
                if "values" in self.columns:
                    row["values"] = None if texts is not None else np.ravel(what).astype(float).tolist()
                yield tuple(row[c] for c in self.columns)


class Reader(_Reads, DataSourceReader):
    def partitions(self) -> list[Files]:
        files = [f for f in listed(self.folder, self.kinds) if self.paths is None or f[1] in self.paths]
        return dealt(files, self.size)


class FilteringReader(Reader):
    """A reader that takes filters; Spark wants it only where they are pushed down."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  (Spark's name)
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("dataset",), ("path",)):
                these, which = {f.value} if isinstance(f, EqualTo) else set(f.value), "names" if f.attribute == ("dataset",) else "paths"
                known = getattr(self, which)
                setattr(self, which, these if known is None else known & these)
            elif isinstance(f, StringStartsWith) and f.attribute == ("dataset",):
                self.starts.append(f.value)
            else:
                yield f


class StreamReader(_Reads, DataSourceStreamReader):
    """Files in the order of their last change; one is taken when it has rested for ``settle`` seconds, and never again."""

    def __init__(self, options: dict, columns: list[str]):
        super().__init__(options, columns)
        self.settle = float(options.get("settle", 1.0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0.0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        now = time.time()
        rested = [f for f in listed(self.folder, self.kinds) if f[0] <= now - self.settle]
        return {"time": rested[-1][0], "path": rested[-1][1]} if rested else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([f for f in listed(self.folder, self.kinds) if low < f[:2] <= high], self.size)

    def commit(self, end: dict) -> None:
        pass


class Recordings(DataSource):
    """Options: ``path``; ``kinds`` (suffixes), ``datasets`` (names), ``bytes`` a partition, ``settle`` (streams), ``filters`` (whether filters are pushed down)."""

    @classmethod
    def name(cls) -> str:
        return "recording_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        kind = FilteringReader if self.options.get("filters", "false") == "true" else Reader
        return kind(dict(self.options), schema.names)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options), schema.names)


def read(spark: SparkSession, folder: str, columns: str | None = None, **options) -> DataFrame:
    """All datasets below a folder; ``columns``: a schema with fewer columns."""
    spark.dataSource.register(Recordings)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    r = spark.read.format("recording_files").options(filters=pushed, **options)
    return (r.schema(columns) if columns else r).load(folder)


def stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The same of a folder that grows."""
    spark.dataSource.register(Recordings)
    return spark.readStream.format("recording_files").options(path=folder, **options).load()
