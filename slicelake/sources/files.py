"""Header tables, manifests, sessions, attestations and evidence as files. All reading and writing is Spark's."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.scratch import written

c = F.col
SESSION = "id string, reader string, mode string, studies array<struct<uid: string, date: string, series: array<struct<uid: string, modality: string, disposition: string>>>>, claims array<struct<id: string, text: string, priority: string>>, pages array<struct<path: string, reviewed: boolean, purpose: string>>"
ATTESTATION = "ts timestamp, reader string, session_id string, series_uid string, sop_uid string, dwell_ms double, scale double, focused boolean, visible boolean, source string, page_path string"


def read_instances(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """Headers under a folder, as JSON lines or Parquet; hidden files are skipped, rows that can't be read too, and rows with neither slice UID nor modality."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true")
    rows = rows.option("mode", "DROPMALFORMED").json(path) if form == "json" else rows.parquet(path)
    return rows.where(c("sop_uid").isNotNull() | c("modality").isNotNull())


#: Files up to so many bytes are rows of the file source, and hashed in the JVM.
WHOLE = 64 << 20
#: Longer ones are read so many bytes at a time.
CHUNK = 8 << 20


def digest_in_chunks(path: str, chunk: int = CHUNK) -> str:
    """SHA-256 of a file of any length, which is never held whole; ``path`` is local or of a scheme that Arrow opens (hdfs, s3, s3a, gs, abfs)."""
    scheme, rest = path.split(":", 1) if ":/" in path else ("file", path)
    if scheme == "file":
        fs, name = LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        fs, name = FileSystem.from_uri(quote(f"{'s3' if scheme == 's3a' else scheme}:{rest}", safe="/:@"))
    digest = hashlib.sha256()
    with fs.open_input_stream(name, compression=None, buffer_size=0) as stream:
        while part := stream.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", whole: int = WHOLE) -> DataFrame:
    """(path, size, at, hash) of every file under a folder that has any bytes, of any length.

    Files longer than ``whole`` bytes are read chunk by chunk, a file a task, as a digest goes from start to end; the
    file source lists them and doesn't read their content. It passes over files of no bytes: they are not in the manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in enumerate(b.column("path").to_pylist()):
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([digest_in_chunks(name)], pa.string())], [*row.schema.names, "hash"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    listed = ("path", c("length").alias("size"), c("modificationTime").alias("at"))
    short = files.where(c("length") <= whole).select(*listed, F.sha2("content", 256).alias("hash"))
    return short.unionByName(files.where(c("length") > whole).select(*listed).mapInArrow(run, "path string, size long, at timestamp, hash string"))


def folder_signature(manifest: DataFrame) -> DataFrame:
    """(folder, files, bytes, newest) for change detection."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return manifest.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("at").alias("newest"))


def read_sessions(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """A ledger's documents, one a file or one a line, as tables: sessions, studies, series, claims, pages."""
    docs = spark.read.schema(SESSION).option("multiLine", str(not lines).lower()).json(path)
    studies = docs.select(c("id").alias("session_id"), F.inline("studies"))
    return {
        "sessions": docs.select(c("id").alias("session_id"), "reader", "mode"), "studies": studies.select("session_id", c("uid").alias("study_uid"), "date"),
        "series": studies.select("session_id", c("uid").alias("study_uid"), F.inline("series")).withColumnRenamed("uid", "series_uid"), "claims": docs.select(c("id").alias("session_id"), F.inline("claims")).withColumnRenamed("id", "claim_id"), "pages": docs.select(c("id").alias("session_id"), F.inline("pages")),
    }


def read_attestations(spark: SparkSession, path: str) -> DataFrame:
    """Attestations as JSON lines; malformed lines are skipped."""
    return spark.read.schema(ATTESTATION).option("mode", "DROPMALFORMED").json(path)


def evidence(df: DataFrame) -> DataFrame:
    """(evidence_id, hash, payload) of rows with an evidence_id."""
    body = F.to_json(F.struct(*[x for x in df.columns if x != "evidence_id"]))
    return df.select("evidence_id", F.sha2(body, 256).alias("hash"), body.alias("payload"))


def append_once(new: DataFrame, path: str, key: str, what: str) -> int:
    """Appends rows (key, hash, ...) whose key isn't there yet, equal ones once, and returns how many there were.

    Raises, and writes nothing, if a key stands there, or among the new rows, with another hash. One writer at a time.
    """
    spark = new.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = new.select(key, "hash")
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    if there:
        old = spark.read.schema(new.schema).parquet(path)
        known = known.unionByName(old.select(key, "hash"))
    if not known.groupBy(key).agg(F.count_distinct("hash").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{what} exists with other content")
    rows = new.dropDuplicates([key])
    rows = written(rows.join(old.select(key), key, "left_anti") if there else rows, "once")
    rows.write.mode("append").parquet(path)
    return rows.count()


def write_evidence_once(df: DataFrame, path: str) -> int:
    """Appends evidence that isn't there yet and returns how many rows there were; raises if an id has two contents. Nothing is overwritten."""
    return append_once(evidence(df), path, "evidence_id", "evidence")


def write_page_index(sources: DataFrame, path: str) -> int:
    """Appends the index of pages (page_id, sop_uid) that isn't there yet; raises if a page stands there with other sources: a changed page needs a new name."""
    return append_once(page_index(sources), path, "page_id", "page")


def page_index(sources: DataFrame) -> DataFrame:
    """(page_id, n, hash): the hash of a page's ordered sources."""
    ordered = F.array_sort(F.collect_list("sop_uid"))
    return sources.groupBy("page_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(ordered, "|"), 256).alias("hash"))


def to_json_documents(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("document"))


def instance_stream(spark: SparkSession, path: str, schema: str, files: int = 10) -> DataFrame:
    """Headers that newly arrive under a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
