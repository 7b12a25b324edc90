"""The inverted index as DataFrames: postings, document lengths, term and collection statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textharbor.config import Analysis
from textharbor.functions.analysis import analyzed, field_texts

BLOCK = 64


def newest(docs: DataFrame, seg: str = "seg") -> DataFrame:
    """The newest version of each document: that of the highest generation."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col(seg).desc()))
    return docs.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def live(docs: DataFrame, deleted: DataFrame | None = None, seg: str = "seg") -> DataFrame:
    """Newest versions without tombstoned documents."""
    docs = newest(docs, seg)
    return docs if deleted is None else docs.join(deleted.select("doc_id"), "doc_id", "left_anti")


@dataclass
class IndexView:
    """What queries read. All parts are lazy; ``cached`` or a written index keeps them.

    docs: as given. doclen(doc_id, field, len): emitted terms, fields without text included.
    postings(field, term, doc_id, positions, tf, len): len is the field's length in that document.
    """

    docs: DataFrame
    doclen: DataFrame
    postings: DataFrame
    analysis: Analysis
    #: What a written index keeps besides: (field, term, df, first_doc, last_doc); (field, term, block, n, max_tf, min_len, df); statistics per field. Its postings have df and block.
    dictionary: DataFrame | None = None
    block_bounds: DataFrame | None = None
    fields: dict[int, tuple[int, int, float]] | None = None
    shift: int | None = None

    @staticmethod
    def of(docs: DataFrame, analysis: Analysis = Analysis()) -> IndexView:
        """Index of live documents (one row per doc_id)."""
        texts = field_texts(docs)
        rows = [
            docs.select("doc_id", F.lit(number).cast("int").alias("field"), analyzed(text, analysis.of(number)).alias("terms"))
            for number, text in texts.items()
        ]
        if all(analysis.of(n) == analysis.of(0) for n in texts):  # one pass over the documents serves all fields
            each = F.explode(F.array(*[F.struct(F.lit(n).cast("int").alias("field"), t.alias("text")) for n, t in texts.items()]))
            by_field = docs.select("doc_id", each.alias("x")).select("doc_id", "x.field", analyzed(F.col("x.text"), analysis.of(0)).alias("terms"))
        else:
            by_field = rows[0]
            for more in rows[1:]:
                by_field = by_field.unionByName(more)
        by_field = by_field.withColumn("len", F.size("terms"))
        tokens = by_field.select("doc_id", "field", "len", F.explode("terms").alias("x")).select("doc_id", "field", "len", "x.term", "x.position")
        postings = tokens.groupBy("field", "term", "doc_id").agg(
            F.sort_array(F.collect_list("position")).alias("positions"), F.count("*").cast("int").alias("tf"), F.first("len").alias("len")
        )
        return IndexView(docs, by_field.select("doc_id", "field", "len"), postings, analysis)

    def termstats(self) -> DataFrame:
        """(field, term, df, first_doc, last_doc)."""
        if self.dictionary is not None:
            return self.dictionary
        return self.postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))

    def stats(self) -> DataFrame:
        """(field, total_tokens, n_docs, avg_len)."""
        if self.fields is not None:
            return self.docs.sparkSession.createDataFrame([(f, *x) for f, x in sorted(self.fields.items())], "field int, total_tokens long, n_docs long, avg_len double")
        by_field = self.doclen.groupBy("field").agg(F.sum("len").alias("total_tokens"), F.countDistinct("doc_id").alias("n_docs"))
        return by_field.withColumn("avg_len", F.col("total_tokens") / F.greatest(F.col("n_docs"), F.lit(1)))

    def vocabulary(self, field: int) -> DataFrame:
        terms = self.postings if self.dictionary is None else self.dictionary
        return terms.where(F.col("field") == field).select("term").distinct().orderBy("term")

    def blocks(self, size: int = BLOCK) -> DataFrame:
        """postings with ``block``: every ``size`` consecutive documents of a term, as pruning and segment layout use them.

        Documents are put into ranges of equal width first, so that a frequent term is numbered by many tasks and not by one.
        """
        part = F.floor(F.col("doc_id") / 65536)
        counts = self.postings.groupBy("field", "term", part.alias("part")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("field", "term").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.select("field", "term", "part", F.coalesce(before, F.lit(0)).alias("before"))
        rank = F.row_number().over(Window.partitionBy("field", "term", "part").orderBy("doc_id")) - 1
        numbered = self.postings.withColumn("part", part).withColumn("rank", rank)
        return numbered.join(counts, ["field", "term", "part"]).withColumn("block", F.floor((F.col("rank") + F.col("before")) / size).cast("int")).drop("part", "rank", "before")

    def bounds(self) -> DataFrame:
        """(field, term, block, n, max_tf, min_len, df): what limits the contribution of a range of ids, whatever the ranking."""
        if self.block_bounds is not None:
            return self.block_bounds
        rows = self.postings.join(self.termstats().select("field", "term", "df"), ["field", "term"])
        return bounds_of(rows.withColumn("block", block_of(F.col("doc_id"), self.id_shift())))

    def id_shift(self) -> int:
        """How many low bits of ids make up a range, so that it holds about ``BLOCK`` documents however sparse ids are."""
        if self.shift is not None:
            return self.shift
        r = self.docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
        return max(0, ((r.high - r.low + 1) * BLOCK // r.n - 1).bit_length()) if r.n else 6

    def cached(self) -> IndexView:
        return replace(self, docs=self.docs.persist(), doclen=self.doclen.persist(), postings=self.postings.persist())

    def released(self) -> IndexView:
        """Lets go of what ``cached`` keeps."""
        return replace(self, docs=self.docs.unpersist(), doclen=self.doclen.unpersist(), postings=self.postings.unpersist())


def block_of(doc_id: Column, shift: int) -> Column:
    """The range of ids that a document lies in. Ranges are the same for all terms, so bounds of terms add up."""
    return F.shiftright(doc_id.cast("bigint"), shift)


def bounds_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term", "block").agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.first("df").alias("df")
    )
