"""JSON lines, JSON, CSV and digests: the file formats that hand work from stage to stage.

Tables are read and written by Spark, so any path that its readers open will do; small
artefacts (manifests, reports, settings) are written by the driver, first under another
name, so that no half-written file is ever seen."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestack.operators.numbering import BROADCAST_OFFSETS
from lodestack.sources.digests import lines_digest
from lodestack.storage import delete_path, join_parts, new_path, path_exists, rename_path, written

#: Kinds of model files that count, and folders that do not.
MODEL_FILES = (".json", ".safetensors", ".bin", ".pt", ".model", ".txt")
MODEL_SKIPS = ("onnx", "imgs", ".git", ".cache")
_BLOCK = 1 << 20
_CORRUPT, _OBJECT = "_not_of_the_schema", r"^\s*\{"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, id, value): every line with its file, the first byte of its split, and its place among all lines of its task."""
    recover(spark, path)
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")


def _splits(rows: DataFrame, *more: Column) -> DataFrame:
    """(file, start, first, n, ...) of every split, with ``before``: the lines of the file before it, and ``rows_before``: all lines before it, files by name."""
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), *more)
    splits = written(splits, "splits")
    own = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
    files = splits.groupBy("file").agg(F.sum("n").alias("size"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select(F.col("file").alias("of"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("files_before"))
    return splits.join(files, F.col("file") == F.col("of")).drop("of").withColumn("rows_before", F.col("before") + F.col("files_before"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, row, value): all lines with their number in their file and among all files by name, from 1; blank ones count.

    Lines are read and numbered split by split and written once, then splits' counts are summed up to offsets."""
    rows = written(_lines(spark, path), "lines")
    splits = written(_splits(rows).select(F.col("file").alias("of"), F.col("start").alias("at"), "first", "before", "rows_before"), "offsets")
    small = F.broadcast(splits) if splits.count() <= BROADCAST_OFFSETS else splits
    place = F.col("id") - F.col("first") + 1
    joined = rows.join(small, (F.col("file") == F.col("of")) & (F.col("start") == F.col("at")))
    return joined.select("file", (place + F.col("before")).alias("line"), (place + F.col("rows_before")).alias("row"), "value")


def bad_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, line, excerpt): of every split that has any, the first line that is no JSON object or does not fit the schema. One pass."""
    kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*kinds.fields, StructField(_CORRUPT, StringType())])
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})[_CORRUPT].isNotNull()
    bad = (F.trim("value") != "") & (~F.col("value").rlike(_OBJECT) | parsed)
    rows = _lines(spark, path).select("file", "start", "id", F.when(bad, F.struct("id", F.substring("value", 1, 80).alias("excerpt"))).alias("bad"))
    found = _splits(rows, F.min("bad").alias("bad")).where("bad IS NOT NULL")
    return found.select("file", (F.col("bad.id") - F.col("first") + 1 + F.col("before")).alias("line"), "bad.excerpt")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, check: bool = False) -> DataFrame:
    """One row per line that is not blank. A line that is no JSON object, or does not fit the schema, fails the read.

    ``check`` looks through all lines first and names the first bad one by file and number; without it the
    read fails as it gets there, with the file's name."""
    if check and (found := bad_lines(spark, path, schema).orderBy("file", "line").first()):
        raise ValueError(f"{found['file']}:{found['line']}: no JSON object of the schema: {found['excerpt']}")
    recover(spark, path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    refused = F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80)))
    whole = F.when(F.col("value").rlike(_OBJECT), F.col("value")).otherwise(refused)
    return lines.select(F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def _in_order(col: Column, kind: Any) -> Column:
    """``col`` with the fields of its structs in the order of their names, at every depth."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(col.isNotNull(), F.struct(*(_in_order(col[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(col, lambda x: _in_order(x, kind.elementType))
    return col


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False, sort_keys: bool = True) -> str:
    """One JSON object per row, nulls too, keys in order unless told otherwise; an existing path is refused unless ``overwrite``."""
    fields = sorted(df.schema.fields, key=lambda f: f.name) if sort_keys else df.schema.fields
    rows = df.select(*(_in_order(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)) if sort_keys else df
    return publish(rows, path, lambda df, at: df.write.option("ignoreNullFields", "false").json(at), overwrite)


def publish(df: DataFrame, path: str, write: Callable[[DataFrame, str], None], overwrite: bool = False) -> str:
    """``df`` written aside and then renamed, so that a reader sees the old table or the new one, whole.

    A replaced table steps aside before the new one comes; if a run stops between, ``recover`` brings it back."""
    spark = df.sparkSession
    recover(spark, path)
    if path_exists(spark, path) and not overwrite:
        raise FileExistsError(path)
    new, old = f"{_aside(path)}.new-{uuid.uuid4().hex[:12]}", f"{_aside(path)}.old"
    try:
        write(df, new)
    except BaseException:
        delete_path(spark, new)
        raise
    if path_exists(spark, path):
        if not overwrite:
            delete_path(spark, new)
            raise FileExistsError(path)
        delete_path(spark, old)
        rename_path(spark, path, old)
    rename_path(spark, new, path)
    delete_path(spark, old)
    return path


def recover(spark: SparkSession, path: str) -> None:
    """Brings back a table that stepped aside for one that never came."""
    old = f"{_aside(path)}.old"
    if path_exists(spark, old) and not path_exists(spark, path):
        rename_path(spark, old, path)


def _aside(path: str) -> str:
    folder, _, name = str(path).rstrip("/").rpartition("/")
    return f"{folder}/.{name}" if folder or str(path).startswith("/") else f".{name}"


def write_bytes(path: str | Path, data: bytes, overwrite: bool = False) -> Path:
    """All of it or nothing: another name first, flushed to the disk, then renamed."""
    path = Path(path)
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=path.parent, prefix=path.name, suffix=".part", delete=False) as out:
        try:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
            out.close()
            if overwrite:
                os.replace(out.name, path)
            else:
                os.link(out.name, path)  # fails where another process was first
        finally:
            Path(out.name).unlink(missing_ok=True)
    return path


def write_lines(lines: DataFrame, path: str | Path, head: str = "", tail: str = "") -> Path:
    """The texts of ``lines`` (value), each with a line break, in their order, between ``head`` and ``tail``; an existing file is replaced.

    Tasks write parts, which are joined a block of bytes at a time: no rows come to the driver."""
    spark, path = lines.sparkSession, Path(path).absolute()
    path.parent.mkdir(parents=True, exist_ok=True)
    parts, draft = new_path(spark, "lines"), path.with_name(f".{path.name}.{uuid.uuid4().hex[:12]}.part")
    try:
        lines.select("value").write.text(parts)
        join_parts(spark, parts, str(draft), head.encode(), tail.encode())
        os.replace(draft, path)
    finally:
        delete_path(spark, parts)
        draft.unlink(missing_ok=True)
    return path


def write_json(path: str | Path, value: Any, overwrite: bool = False) -> Path:
    return write_bytes(path, (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode(), overwrite)


def write_csv(path: str | Path, rows: Iterable[Mapping[str, Any]], columns: Sequence[str], extra: str = "ignore", overwrite: bool = True) -> Path:
    """A small table with the given columns. ``extra`` says whether further keys are ignored ("ignore") or refused ("raise")."""
    out = io.StringIO(newline="")
    made = csv.DictWriter(out, columns, extrasaction=extra)
    made.writeheader()
    made.writerows(rows)
    return write_bytes(path, out.getvalue().encode(), overwrite)


def file_sha256(path: str | Path) -> str:
    """The digest of a file, or of a folder: of the digests of its data files in the order of their names."""
    if Path(path).is_dir():
        return object_sha256([file_sha256(p) for p in sorted(Path(path).iterdir()) if not p.name.startswith(("_", "."))])
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(_BLOCK):
            digest.update(block)
    return digest.hexdigest()


def digest_of(spark: SparkSession, path: str | Path) -> str:
    """The plain digest of a single local file, that of its lines for a table of any size."""
    return file_sha256(path) if Path(path).is_file() else lines_digest(spark, str(path))


def object_sha256(value: Any) -> str:
    """The digest of the canonical form: sorted keys, no spaces, characters as they are."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def copy_frozen(sources: Mapping[str, str | Path], folder: str | Path, spark: SparkSession | None = None) -> dict[str, Path]:
    """Copies of the named files and tables; what is there already must hold the same.

    Tables (folders of lines) are copied and compared by tasks, line by line; single files are small, and copied whole."""
    made: dict[str, Any] = {}
    for name, source in sources.items():
        at = f"{str(folder).rstrip('/')}/{name}"
        target = at if "://" in at else Path(at)
        if "://" not in str(source) and not Path(source).is_dir():
            if not Path(at).exists():
                write_bytes(at, Path(source).read_bytes())
            same = file_sha256(at) == file_sha256(source)
        else:
            spark = spark or SparkSession.active()
            recover(spark, at)
            if not path_exists(spark, at):
                publish(spark.read.text(str(source)), at, lambda df, path: df.write.text(path))
            same = lines_digest(spark, at) == lines_digest(spark, str(source))
        if not same:
            raise ValueError(f"{target} differs from {source}")
        made[name] = target
    return made


def installed_versions(packages: Sequence[str] = ("pyspark", "pyarrow", "numpy", "pandas", "PyYAML")) -> dict[str, str | None]:
    """The version of each package, null where it is absent."""

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    return {name: version(name) for name in packages}


def model_fingerprint(folder: str | Path, revision: str) -> dict[str, Any]:
    """Sizes and digests of a model's files, and one digest of them all."""
    folder = Path(folder)
    inside = (p.relative_to(folder) for p in sorted(folder.rglob("*")) if p.is_file() and p.suffix.lower() in MODEL_FILES)
    files = {str(p): {"bytes": (folder / p).stat().st_size, "sha256": file_sha256(folder / p)} for p in inside if not set(p.parts) & set(MODEL_SKIPS)}
    if not files:
        raise ValueError(f"no model files in {folder}")
    return {
        "configured_revision": revision,
        "hub_snapshot_path_matches_revision": folder.name == revision and folder.parent.name == "snapshots",
        "files": files,
        "combined_sha256": object_sha256(files),
    }


def model_folder(config: Mapping[str, Any], cache: str | Path | None = None) -> Path:
    """The local folder of a pinned model: ``local_path``, or the revision's snapshot in ``cache``. Nothing is downloaded."""
    if config.get("local_path"):
        found = Path(config["local_path"])
    elif cache is not None:
        found = Path(cache) / ("models--" + str(config["model_id"]).replace("/", "--")) / "snapshots" / str(config["revision"])
    else:
        raise ValueError("a local_path or a cache is needed")
    if not found.is_dir():
        raise FileNotFoundError(found)
    return found
