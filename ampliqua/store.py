"""Tables kept under the hash of what they are made from, so that runs share them: a control's tokens are made once.

A table is written to a folder of its own under the cache's root and then named in a manifest, which is put there in one
step: what a stopped run has half written is never read. Nothing is changed in place; two runs that make the same table at
once each write their own, and the manifest of the one that ends first stays.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def files_of(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """Name, bytes and time of change of every file under these paths, in the order of their names."""
    out = []
    for path in paths:
        fs, at = _fs(spark, path)
        if not fs.exists(at):
            raise FileNotFoundError(path)
        found = fs.listFiles(at, True) if fs.getFileStatus(at).isDirectory() else None
        states = [fs.getFileStatus(at)] if found is None else []
        while found is not None and found.hasNext():
            states.append(found.next())
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in states]
    return sorted(out)


def key_of(*parts: object) -> str:
    """A hash of names, numbers and what files_of tells."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def kept(spark: SparkSession, root: str, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name and key, made by build if it isn't there yet."""
    fs, manifest = _fs(spark, f"{root.rstrip('/')}/{name}-{key}.json")
    if not fs.exists(manifest):
        df, folder = build(), f"{root.rstrip('/')}/{name}-{key}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        draft = _fs(spark, f"{root.rstrip('/')}/.{uuid.uuid4().hex}")[1]
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"folder": folder, "schema": df.schema.jsonValue()}).encode()))
        stream.close()
        if not fs.rename(draft, manifest):  # another run was first
            fs.delete(draft, False)
    stream = fs.open(manifest)
    told = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    stream.close()
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(told["schema"])).parquet(told["folder"])
