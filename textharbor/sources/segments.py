"""Segments and the manifest: immutable index generations on disk.

A segment is one partition ``seg=N`` of the documents. The manifest is the only file that changes, and is replaced as
a whole: readers see a segment or they do not.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textharbor.config import Analysis
from textharbor.operators.index import IndexView, block_of, bounds_of, live
from textharbor.operators.lineage import cut
from textharbor.sources.store import exists, read_text, write_text


class CorruptManifest(ValueError):
    """The manifest cannot be read."""


class CorruptIndex(ValueError):
    """A written index does not hold what was written."""


@dataclass
class Manifest:
    generation: int = 0
    segments: list[int] = field(default_factory=list)
    deleted: list[int] = field(default_factory=list)
    #: Segment of each batch of a stream: a batch that comes again is not written again.
    batches: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Manifest:
        """The manifest of a directory; a missing one is empty, an unreadable one an error."""
        text = read_text(f"{path}/manifest.json")
        if text is None:
            return Manifest()
        try:
            data = json.loads(text)
            batches = {str(k): int(v) for k, v in data.get("batches", {}).items()}
            found = Manifest(int(data["generation"]), [int(x) for x in data["segments"]], [int(x) for x in data.get("deleted", [])], batches)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise CorruptManifest(f"{path}/manifest.json: {e}") from e
        return found

    def store(self, path: str) -> None:
        write_text(f"{path}/manifest.json", json.dumps(asdict(self)))

    def next_id(self) -> int:
        return max([self.generation, *self.segments], default=0) + 1

    def remove_segment(self, seg: int) -> bool:
        """Take a segment out; whether it was in."""
        if seg not in self.segments:
            return False
        self.segments.remove(seg)
        self.generation += 1
        return True

    def clear_tombstones(self) -> int:
        """Forget all tombstones; their number."""
        n, self.deleted = len(self.deleted), []
        self.generation += n > 0
        return n


def write_segment(docs: DataFrame, path: str, batch: str | None = None) -> int:
    """Write documents as a new generation, check its row count, then enter it in the manifest. batch: the name under which a stream's batch is known."""
    manifest = Manifest.load(path)
    if batch is not None and batch in manifest.batches:
        return manifest.batches[batch]
    seg = manifest.next_id()
    where = f"{path}/docs/seg={seg}"
    docs.drop("seg").write.mode("overwrite").parquet(where)
    docs.sparkSession.read.parquet(where).count()  # readable as a whole
    manifest.segments.append(seg)
    manifest.generation = seg
    if batch is not None:
        manifest.batches[batch] = seg
    manifest.store(path)
    return seg


def delete(path: str, doc_id: int) -> bool:
    """Enter a tombstone; whether the document was not deleted before. A tombstone stays when the id comes in again."""
    manifest = Manifest.load(path)
    if doc_id in manifest.deleted:
        return False
    manifest.deleted.append(doc_id)
    manifest.generation += 1
    manifest.store(path)
    return True


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """All versions of all documents in the manifest's segments, with ``seg``."""
    manifest = Manifest.load(path)
    if not manifest.segments:
        raise FileNotFoundError(f"no segments in {path}")
    return spark.read.option("basePath", f"{path}/docs").parquet(*[f"{path}/docs/seg={s}" for s in manifest.segments])


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """Newest versions without tombstoned documents."""
    manifest = Manifest.load(path)
    docs = live(read_docs(spark, path))
    if not manifest.deleted:
        return docs
    gone = spark.createDataFrame([(i,) for i in manifest.deleted], "doc_id bigint")
    return docs.join(gone, "doc_id", "left_anti")


def merge(spark: SparkSession, path: str) -> int | None:
    """Rewrite the live documents as one segment and clear tombstones; None where there is nothing to merge."""
    manifest = Manifest.load(path)
    if len(manifest.segments) < 2 and not manifest.deleted:
        return None
    docs = read_live(spark, path)
    if not docs.limit(1).count():
        return None
    seg = manifest.next_id()
    docs.drop("seg").write.mode("overwrite").parquet(f"{path}/docs/seg={seg}")
    Manifest(seg, [seg], [], dict.fromkeys(manifest.batches, seg)).store(path)
    return seg


def write_index(view: IndexView, path: str, files: int | None = None) -> None:
    """Keep an index. Postings carry df and block, and are range-partitioned and sorted by field, term and document, so that lookups read few row groups.

    Beside them: documents, dictionary, block bounds, field lengths and, written last, a file of statistics with the tables' row counts and check sums.
    An index without that file is not complete.
    """
    spark = view.docs.sparkSession
    spread = lambda df, *by: (df.repartitionByRange(*by) if files is None else df.repartitionByRange(files, *by)).sortWithinPartitions(*by)
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    view.docs.write.mode("overwrite").parquet(f"{path}/docs")
    view = IndexView.of(table("docs"), view.analysis)  # documents may be costly to make: from here on they are read
    shift = view.id_shift()
    postings = cut(view.postings.select("field", "term", "doc_id", "positions", "tf", "len"))  # texts are analyzed once
    terms = postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    spread(terms, "field", "term").write.mode("overwrite").parquet(f"{path}/dictionary")
    rows = postings.join(table("dictionary").select("field", "term", "df"), ["field", "term"]).withColumn("block", block_of(F.col("doc_id"), shift))
    spread(rows, "field", "term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    spread(bounds_of(table("postings")), "field", "term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    known = postings.groupBy("doc_id", "field").agg(F.max("len").alias("len"))
    every = view.docs.select("doc_id", F.explode(F.array(*[F.lit(f) for f in range(4)])).alias("field"))
    every.join(known, ["doc_id", "field"], "left").fillna(0, ["len"]).write.mode("overwrite").parquet(f"{path}/doclen")
    kept = IndexView(view.docs, table("doclen"), postings, view.analysis)
    fields = {r.field: (r.total_tokens, r.n_docs, r.avg_len) for r in kept.stats().collect()}
    sums = {name: _check_sum(table(name)) for name in TABLES}
    write_text(f"{path}/statistics.json", json.dumps({"fields": fields, "shift": shift, "tables": sums}))


TABLES = ("postings", "dictionary", "blocks", "doclen")


def _check_sum(df: DataFrame) -> list[int]:
    """[rows, sum of the rows' CRC32]."""
    row = F.concat_ws("\x00", *[F.array_join(F.col(c).cast("array<string>"), ",") if t.startswith("array") else F.col(c).cast("string") for c, t in df.dtypes])
    return list(df.agg(F.count("*"), F.coalesce(F.sum(F.crc32(row)), F.lit(0))).first())


def is_complete(path: str) -> bool:
    """Whether a folder holds a written index with all its tables."""
    return read_text(f"{path}/statistics.json") is not None and all(exists(f"{path}/{name}/_SUCCESS") for name in (*TABLES, "docs"))


def read_index(spark: SparkSession, path: str, docs: DataFrame | None = None, analysis: Analysis = Analysis()) -> IndexView:
    """A written index; docs: live documents, where not all that were written are live any more."""
    text = read_text(f"{path}/statistics.json")
    if text is None:
        raise CorruptIndex(f"{path} holds no complete index")
    kept = json.loads(text)
    fields = {int(f): (int(x[0]), int(x[1]), float(x[2])) for f, x in kept["fields"].items()}
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    return IndexView(table("docs") if docs is None else docs, table("doclen"), table("postings"), analysis, table("dictionary"), table("blocks"), fields, kept["shift"])


def verify_index(spark: SparkSession, path: str) -> DataFrame:
    """(table, rows, expected, sound) of a written index: every table read as a whole and compared with what was written."""
    text = read_text(f"{path}/statistics.json")
    if text is None:
        raise CorruptIndex(f"{path} holds no complete index")
    rows = []
    for name, expected in json.loads(text)["tables"].items():
        got = _check_sum(spark.read.parquet(f"{path}/{name}"))
        rows.append((name, got[0], expected[0], got == list(expected)))
    return spark.createDataFrame(rows, "table string, rows long, expected long, sound boolean")


def verify_segments(spark: SparkSession, path: str) -> DataFrame:
    """(seg, rows, readable) of every segment in the manifest, each read as a whole."""
    rows = []
    for seg in Manifest.load(path).segments:
        try:
            rows.append((seg, _check_sum(spark.read.parquet(f"{path}/docs/seg={seg}").select("doc_id", "body"))[0], True))
        except Exception:  # whatever a broken file raises
            rows.append((seg, 0, False))
    return spark.createDataFrame(rows, "seg int, rows long, readable boolean")


def copy_segments(spark: SparkSession, source: str, target: str) -> int:
    """Copy the segments that the target lacks, compare rows and check sums, then take over the manifest. Returns the number of segments copied."""
    manifest, n = Manifest.load(source), 0
    for seg in manifest.segments:
        if seg in Manifest.load(target).segments:
            continue
        rows = spark.read.parquet(f"{source}/docs/seg={seg}")
        rows.write.mode("overwrite").parquet(f"{target}/docs/seg={seg}")
        plain = [c for c, t in rows.dtypes if not t.startswith(("map", "struct"))]
        if _check_sum(rows.select(*plain)) != _check_sum(spark.read.parquet(f"{target}/docs/seg={seg}").select(*plain)):
            raise CorruptIndex(f"segment {seg} differs after the copy")
        n += 1
    manifest.store(target)
    return n


def current_index(spark: SparkSession, path: str, analysis: Analysis) -> IndexView:
    """The written index of the live documents; written anew where segments, tombstones or the analysis changed since."""
    where = f"{path}/index/{zlib.crc32(repr(analysis).encode()):08x}-{Manifest.load(path).generation}"
    if read_text(f"{where}/statistics.json") is None:
        write_index(IndexView.of(read_live(spark, path), analysis), where)
    return read_index(spark, where, analysis=analysis)


def segment_report(docs: DataFrame) -> DataFrame:
    """(seg, docs, rows) per generation."""
    return docs.groupBy("seg").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("rows"))
