"""Files that tasks write and others read: sorted arrays, perfect hashes, automata, and tables that cut lineage.

They lie under ``spark.checkpoint.dir``, which all executors of a cluster share.  A file is written under a name of its
own attempt and then renamed, so a task that runs again, or twice at once, leaves one whole file.  Where the folder is
mounted (a ``file:`` address) arrays are memory-mapped; elsewhere they are read through Arrow's file systems.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sheaf.storage import BATCH, bound_batches, shared_folder  # noqa: F401


def fresh(*names: str) -> list[str]:
    """Column names that no table has."""
    return [f"_{n}_{uuid.uuid4().hex}" for n in names]


def folder(spark: SparkSession, what: str) -> str:
    """A new folder's address for one run of an operator; its tasks get batches of bounded size.  ``sheaf.clean`` deletes it."""
    return shared_folder(spark, what)


def table(df: DataFrame, where: str, name: str) -> DataFrame:
    """Writes df as Parquet and reads it again: what follows doesn't depend on lost shuffle files."""
    df.write.parquet(f"{where}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{where}/{name}")


def _local(address: str) -> str | None:
    u = urlparse(address)
    return unquote(u.path) if u.scheme in ("", "file") else None


def save(where: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Stores one-dimensional arrays in a single file and returns its address."""
    head, at = [], 0
    for key, a in arrays.items():
        head.append((key, a.dtype.str, len(a), at))
        at += -(-a.nbytes // 64) * 64
    meta = json.dumps(head).encode()
    first = -(-(len(meta) + 8) // 64) * 64
    address, path = f"{where}/{name}", _local(f"{where}/{name}")
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        out = open(own, "wb")  # noqa: SIM115
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(address)
        own = f"{path}.{uuid.uuid4().hex}"
        store.create_dir(os.path.dirname(path), recursive=True)
        out = store.open_output_stream(own)
    with out:
        out.write(len(meta).to_bytes(8, "little") + meta)
        out.write(b"\0" * (first - 8 - len(meta)))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).data)
            out.write(b"\0" * (-a.nbytes % 64))
    if _local(address) is not None:
        os.replace(own, path)
    else:
        store.move(own, path)
    return address


_OPEN: OrderedDict[str, tuple[dict[str, np.ndarray], int]] = OrderedDict()
#: Bytes of files that a process keeps where they can't be mapped.
HELD = 128 << 20


def load(address: str, most: int = 256) -> dict[str, np.ndarray]:
    """The arrays of a file; the last ``most`` files stay open, and of those that aren't mapped no more than HELD bytes."""
    if address in _OPEN:
        _OPEN.move_to_end(address)
        return _OPEN[address][0]
    path, held = _local(address), 0
    if path is not None:
        raw = np.memmap(path, np.uint8, "r")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(address)
        with store.open_input_file(path) as f:
            raw = np.frombuffer(f.read_buffer(), np.uint8)
        held = raw.nbytes
    size = int.from_bytes(bytes(raw[:8]), "little")
    first = -(-(size + 8) // 64) * 64
    arrays = {}
    for key, kind, n, at in json.loads(bytes(raw[8 : 8 + size])):
        arrays[key] = raw[first + at : first + at + n * np.dtype(kind).itemsize].view(kind).view(np.ndarray)
    _OPEN[address] = arrays, held
    while len(_OPEN) > most or len(_OPEN) > 1 and sum(b for _, b in _OPEN.values()) > HELD:
        _OPEN.popitem(last=False)
    return arrays


def names(where: str) -> set[str]:
    """The names of the files in a folder, from one listing; none if there is no folder."""
    path = _local(where)
    if path is not None:
        return set(os.listdir(path)) if os.path.isdir(path) else set()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(where)
    return {f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True))}
