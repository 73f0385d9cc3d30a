"""Sinks: report folders, Markdown and JSON, evidence, snapshots."""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescape.functions.text import formula_safe, list_text, markdown_cell


def printable(df: DataFrame) -> DataFrame:
    """Every text cell safe for spreadsheets, lists as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((formula_safe(c) if isinstance(f.dataType, T.StringType) else list_text(c) if isinstance(f.dataType, T.ArrayType) else c).alias(f.name))
    return df.select(*out)


def write_views(views: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Each view below its name, by Spark's own writers; headers even without rows."""
    for name, df in views.items():
        w = (printable(df) if kind == "csv" else df).write.mode("overwrite")
        (w.option("header", "true").csv if kind == "csv" else w.json if kind == "json" else w.parquet)(f"{folder}/{name}")


def markdown_lines(df: DataFrame, limit: int) -> list[str]:
    """A report's table of at most `limit` rows; the limit is the report's, and bounds what reaches the driver."""
    names = df.columns
    cells = df.limit(limit).select(*[markdown_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in names]).collect()
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join(r) + " |" for r in cells]]


def write_report(title: str, sections: dict[str, DataFrame], path: str | Path, limit: int = 100) -> None:
    """Markdown beside JSON of the same sections, written whole before they replace older ones."""
    body, data = [f"# {title}"], {}
    for name, df in sections.items():
        body += ["", f"## {name}", "", *markdown_lines(df, limit)]
        data[name] = [r.asDict(recursive=True) for r in df.limit(limit).collect()]
    target = Path(path)
    for suffix, text in ((".md", "\n".join(body) + "\n"), (".json", json.dumps(data, indent=2, default=str))):
        part = target.with_suffix(suffix + ".part")
        part.write_text(text, encoding="utf-8")
        part.replace(target.with_suffix(suffix))


def write_evidence(folder: str | Path, number: int, body: bytes, suffix: str = ".bin") -> tuple[str, str]:
    """A response body under its number and hash; the path and the hash. Unsafe suffixes become .bin."""
    suffix = suffix.lower() if suffix.lower() in (".json", ".html", ".xml", ".pdf", ".txt", ".eml") else ".bin"
    digest = hashlib.sha256(body).hexdigest()
    target = Path(folder) / f"{number:04d}-{digest[:16]}{suffix}"
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(".part")
    part.write_bytes(body)
    part.replace(target)
    return str(target), digest


def store_evidence(files: DataFrame, folder: str) -> DataFrame:
    """Writes contents (sha256, content) below a shared folder under their hashes, and gives sha256, stored_path.

    Tasks write each file below a name of its own and rename it, so a file under its hash is always whole; a task that is
    run again finds or replaces the same bytes. Repeated contents are one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            paths = []
            for digest, content in zip(batch.column("sha256").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{root.rstrip('/')}/{digest[:2]}/{digest}"
                part = f"{target}.{uuid.uuid4().hex}.part"
                system.create_dir(f"{root.rstrip('/')}/{digest[:2]}", recursive=True)
                try:
                    with system.open_output_stream(part) as f:
                        f.write(content)
                    system.move(part, target)
                finally:
                    if system.get_file_info(part).is_file:
                        system.delete_file(part)
                paths.append(f"{folder.rstrip('/')}/{digest[:2]}/{digest}")
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), pa.array(paths, pa.string())], ["sha256", "stored_path"])

    return files.select("sha256", "content").dropDuplicates(["sha256"]).mapInArrow(run, "sha256 string, stored_path string")


def evidence_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """stored_path, sha256 of the files below an evidence folder, the hash of the bytes that are there now; without the
    folder, no rows."""
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException:
        return spark.createDataFrame([], "stored_path string, sha256 string")
    # the reader gives URIs; names are compared without their scheme
    return raw.where(~F.col("path").endswith(".part")).select(F.regexp_replace("path", "^file:/+", "/").alias("stored_path"), F.sha2("content", 256).alias("sha256"))


def swap_snapshot(df: DataFrame, root: str, table: str, version: int) -> str:
    """A table's new version beside the old; readers take the version that the caller then names current."""
    path = f"{root}/{table}/v={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def bundle(files: list[str | Path], target: str | Path) -> str:
    """A zip of files (and of all files below folders), written whole before it replaces an older one."""
    target = Path(target)
    part = target.with_suffix(".zip.part")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        for file in map(Path, files):
            for f in sorted(x for x in file.rglob("*") if x.is_file()) if file.is_dir() else [file]:
                z.write(f, f.relative_to(file.parent))
    part.replace(target)
    return str(target)


def write_json(value: object, path: str | Path) -> str:
    """A status or plan as JSON with sorted keys, written whole; the hash of its bytes."""
    raw = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str).encode()
    part = Path(path).with_suffix(".json.part")
    part.write_bytes(raw)
    part.replace(path)
    return hashlib.sha256(raw).hexdigest()
