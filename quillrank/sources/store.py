"""Keeping an index: every save is a new version folder, and a pointer file names the current one.

The pointer is replaced last, by a rename in one step, so readers see the old index or the new one, never none or a part of it. The manifest holds what
is checked on loading: format version, parameters, row counts and a checksum of every table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Params
from ..errors import ChecksumMismatch, CorruptIndex, HubError, Truncated, UnsupportedVersion
from ..functions.text import Tokenizer
from ..operators.index import Index, Stats

VERSION = 1
TABLES = ("postings", "lengths", "terms")
OPTIONAL = ("ids", "maxima")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _write(spark: SparkSession, path: str, text: str) -> None:
    files, where = _files(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(temporary)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    temporary, where = temporary.makeQualified(files.getUri(), files.getWorkingDirectory()), where.makeQualified(files.getUri(), files.getWorkingDirectory())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, where, how)


def _read(spark: SparkSession, path: str) -> str:
    files, where = _files(spark, path)
    if not files.exists(where):
        raise CorruptIndex(f"{path} isn't there")
    return spark.read.text(path, wholetext=True).first()[0]


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """(rows, checksum) that don't depend on their order."""
    # the sum of the hashes by halves: sums of longs, which are far cheaper than of decimals
    hashed = df.select(F.xxhash64(*df.columns).alias("h"))
    n, high, low = hashed.agg(F.count("*"), F.coalesce(F.sum(F.shiftright("h", 32)), F.lit(0)), F.coalesce(F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0))).first()
    return n, str((high << 32) + low)


def save(index: Index, path: str) -> dict:
    """Writes ``index`` below ``path`` as its current version; the manifest."""
    spark = index.postings.sparkSession
    version = uuid.uuid4().hex
    index.postings.write.parquet(f"{path}/{version}/postings")
    index.lengths.write.parquet(f"{path}/{version}/lengths")
    index.terms.write.parquet(f"{path}/{version}/terms")
    more = [t for t in OPTIONAL if getattr(index, t) is not None]
    for t in more:
        getattr(index, t).write.parquet(f"{path}/{version}/{t}")
    p, s = index.params, index.stats
    manifest = {
        "version": VERSION, "params": {"method": p.method, "k1": p.k1, "b": p.b, "delta": p.delta}, "tokenizer": index.tokenizer.to_json(),
        "stats": {"n_docs": s.n_docs, "n_tokens": s.n_tokens, "mean_length": s.mean_length},
        "tables": {t: fingerprint(spark.read.parquet(f"{path}/{version}/{t}")) for t in (*TABLES, *more)},
        "width": index.width,
    }
    _write(spark, f"{path}/{version}/manifest.json", json.dumps(manifest))
    _write(spark, f"{path}/CURRENT", version)
    return manifest


def load(spark: SparkSession, path: str, verify: bool = True) -> Index:
    """The current index below ``path``. ``verify`` reads all tables once to check them; without it only the manifest is read now."""
    version = _read(spark, f"{path}/CURRENT").strip()
    try:
        manifest = json.loads(_read(spark, f"{path}/{version}/manifest.json"))
        if manifest["version"] != VERSION:
            raise UnsupportedVersion(f"format version {manifest['version']}, not {VERSION}")
        params, stats, tokenizer = Params(**manifest["params"]), Stats(**manifest["stats"]), Tokenizer.from_json(manifest["tokenizer"])
    except (KeyError, TypeError, ValueError) as e:
        raise CorruptIndex(f"bad manifest: {e}") from None
    tables = {}
    for t in manifest["tables"]:
        try:
            tables[t] = spark.read.parquet(f"{path}/{version}/{t}")
            held = fingerprint(tables[t]) if verify else None
        except Exception as e:
            raise Truncated(f"{t} can't be read: {str(e).splitlines()[0]}") from None
        if held and list(held) != list(manifest["tables"][t]):
            raise ChecksumMismatch(f"{t} has {held[0]} rows with checksum {held[1]}, not {manifest['tables'][t]}")
    return Index(tables["postings"], tables["lengths"], tables["terms"], stats, params, tokenizer, tables.get("ids"), tables.get("maxima"), manifest.get("width", 0))


def card(index: Index, name: str) -> str:
    """A description of an index to go with its files."""
    s, p = index.stats, index.params
    return f"""---
tags: [lexical-search, retrieval]
---
# {name}

| | |
|-|-|
| Documents | {s.n_docs:,} |
| Tokens | {s.n_tokens:,} |
| Mean length | {s.mean_length:.2f} |
| Scoring | {p.label} (k1 {p.k1:g}, b {p.b:g}, delta {p.delta:g}) |
"""


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of everything below ``path``."""
    files, where = _files(spark, path)
    return files.getContentSummary(where).getLength()


def push(index: Index, name: str) -> None:
    """Sending an index to a hub needs a network, which this package doesn't use: save it, and send the folder with ``card``'s text by other means."""
    raise HubError(f"{name}: there is no network here; save the index and send its folder")
