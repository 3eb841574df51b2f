"""The lexical index of a corpus: postings, terms and statistics, as frames or kept as Parquet.

The words of a text are counted in its row and its postings are written where it was read, so neither is ever shuffled. A kept index is a row of segments, each made of
some of the corpus' files. When files come or go only the new ones are read; what came from files that are gone or changed is
left out by their marks, and its counts are taken off. Many segments are merged into one from their postings.

Postings lie in folders by a hash of their term, in a file for each task that read some of the corpus, sorted by the hash:
a search reads the folders, and within them the pages, of the words it asks for.

Ids should be distinct: rows that share one are documents of their own with one name.
"""

from __future__ import annotations

import functools
import operator
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexroute.functions import sessions
from lexroute.functions.text import index_tokens

#: Changes with the tokens or the columns of an index, so that older ones count as stale.
FORMAT = "4"
#: Folders of postings; rows of a page, the least that is read; segments from which on they are merged; terms that a search hands to the reader.
BUCKETS, PAGE_ROWS, MOST_SEGMENTS, PUSHED = 32, 1024, 8, 512
#: Bytes of files whose postings a task sorts at once: larger splits do not fit memory, and what is spilled lies on disk for all tasks that run.
SPLIT = 16 << 20
_TABLES = ("postings", "terms", "stats")


class StaleIndex(ValueError):
    """A kept index belongs to another corpus or another form of the index."""


@dataclass(frozen=True)
class LexicalIndex:
    """postings (doc_id, term, tf, dl; kept ones also h and bucket, see bucket()), terms (term, df, cf), stats (n_docs, n_tokens, avgdl; one row)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def asked(self, terms: DataFrame) -> int:
        """How many postings terms (term) ask for, by their counts; 0 if the index is not kept, where counting would make it."""
        if "bucket" not in self.postings.columns:
            return 0
        return self.terms.join(terms.select("term").distinct(), "term", "left_semi").agg(F.sum("df")).first()[0] or 0

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """The postings of the folders and pages that may hold any of terms (term). More than PUSHED terms choose folders only."""
        if "bucket" not in self.postings.columns:
            return self.postings
        asked = terms.filter("term is not null").select(F.xxhash64("term").alias("h"), bucket().alias("bucket")).distinct()
        some = asked.groupBy("bucket").agg(F.count("*").alias("n")).collect()  # at most BUCKETS rows
        found = self.postings.filter(F.col("bucket").isin([r["bucket"] for r in some]))
        if 0 < sum(r["n"] for r in some) <= PUSHED:  # equalities reach the reader, a long list would not
            found = found.filter(_any([F.col("h") == r["h"] for r in asked.select("h").collect()]))
        return found


def _any(conditions: list[Column]) -> Column:
    """Their disjunction, as a tree of little depth."""
    while len(conditions) > 1:
        conditions = [functools.reduce(operator.or_, conditions[k : k + 2]) for k in range(0, len(conditions), 2)]
    return conditions[0]


def bucket() -> Column:
    """The folder of a term: a range of its hash, so that pages sorted by the hash hold none of another folder's terms between their ends."""
    return F.shiftrightunsigned(F.xxhash64("term"), 64 - BUCKETS.bit_length() + 1).cast("int")


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5) + 1))


def _postings(docs: DataFrame, id: str, text: str, *more: Column) -> DataFrame:
    """(doc_id, term, tf, dl, more): runs of equal words in the sorted words of each row."""
    x = docs.select(F.col(id).alias("doc_id"), F.sort_array(index_tokens(F.col(text))).alias("w"), *more).filter(F.size("w") > 0)
    x = x.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1))))
    ends = lambda i, k: F.coalesce(F.get("at", k + 1), F.size("w")) - i
    x = x.withColumn("dl", F.size("w").cast("long")).withColumn("x", F.explode(F.transform("at", lambda i, k: F.struct(F.get("w", i).alias("term"), ends(i, k).cast("long").alias("tf")))))
    return x.select("doc_id", "x.term", "x.tf", "dl", *(c for c in x.columns if c not in ("doc_id", "w", "at", "x", "dl")))


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _stats(docs: DataFrame, terms: DataFrame) -> DataFrame:
    total = terms.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"))
    return docs.agg(F.count("*").alias("n_docs")).join(F.broadcast(total)).select("n_docs", "n_tokens", F.try_divide("n_tokens", "n_docs").alias("avgdl"))  # one row each


def of(docs: DataFrame, id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """An index that is computed where it is used. Null texts count as documents without words."""
    postings = _postings(docs, id, text)
    terms = _terms(postings)
    return LexicalIndex(postings, terms, _stats(docs, terms))


def save(docs: DataFrame, path: str, version: str, id: str = "doc_id", text: str = "text") -> None:
    """Writes the index of docs under `path` and, last of all, what it was made of.

    The tables are written beside the path and moved there as a whole; if another writer was first, its copy stays.
    """
    spark, draft = docs.sparkSession, f"{path}-{uuid.uuid4().hex}"
    _postings(docs, id, text).sortWithinPartitions("term", "doc_id").write.parquet(f"{draft}/postings")
    _terms(spark.read.parquet(f"{draft}/postings")).write.parquet(f"{draft}/terms")
    _stats(docs, spark.read.parquet(f"{draft}/terms")).write.parquet(f"{draft}/stats")
    spark.createDataFrame([(FORMAT, version)], "format string, version string").coalesce(1).write.json(f"{draft}/made_of")
    fs, there, here = _files(spark, path), _path(spark, path), _path(spark, draft)
    if fs.exists(there) or not fs.rename(here, there):
        fs.delete(here, True)


def load(spark: SparkSession, path: str, version: str) -> LexicalIndex:
    """The index kept under `path`; StaleIndex if it was made of another version of the corpus."""
    made = spark.read.schema("format string, version string").json(f"{path}/made_of").first()
    if made is None or tuple(made) != (FORMAT, version):
        raise StaleIndex(f"{path} was made of {made}, not of {(FORMAT, version)}")
    return LexicalIndex(*(spark.read.parquet(f"{path}/{t}") for t in _TABLES))


# --- an index kept in segments ---


def corpus_files(docs: DataFrame) -> DataFrame:
    """(path, f): the files that rows of docs, read straight from files, come from; f changes with name, length and time of change. No column is read."""
    m = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return m.distinct().select(F.col("file_path").alias("path"), F.xxhash64("*").alias("f"))


class Segments:
    """The index of one corpus under a folder: generations (which file is in which segment, and which of them count) and segments."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint"):
        self.spark, self.path, self.schema = spark, path, f"doc_id {kind}, term string, tf long, dl long, f long, h long, bucket int"

    def _names(self, prefix: str) -> list[str]:
        fs, where = _files(self.spark, self.path), _path(self.spark, self.path)
        return sorted(n for s in (fs.listStatus(where) if fs.exists(where) else []) if (n := s.getPath().getName()).startswith(prefix))

    def newest(self) -> str | None:
        return max(self._names("generation-"), default=None)

    def files(self, generation: str | None) -> DataFrame:
        """(path, f, segment, live) of a generation."""
        schema = "path string, f long, segment string, live boolean"
        return self.spark.createDataFrame([], schema) if generation is None else self.spark.read.schema(schema).parquet(f"{self.path}/{generation}")

    def _write_segment(self, postings: DataFrame, docs_of: DataFrame) -> str:
        """postings with f and docs_of (f, n_docs) as a new segment: sorted postings, terms, terms and sizes by file. Each task writes what it has read into the folders: postings are not shuffled."""
        name = f"segment-{uuid.uuid4().hex}"
        with sessions.shuffles_deleted(self.spark), sessions.splits_of(self.spark, SPLIT):
            self._write_tables(name, postings, docs_of)
        return name

    def _write_tables(self, name: str, postings: DataFrame, docs_of: DataFrame) -> None:
        hashed = postings.select("doc_id", "term", "tf", "dl", "f", F.xxhash64("term").alias("h"), bucket().alias("bucket"))
        hashed.sortWithinPartitions("bucket", "h", "doc_id").write.partitionBy("bucket").options(**{"parquet.page.row.count.limit": PAGE_ROWS, "compression": "zstd"}).parquet(f"{self.path}/{name}/postings")
        by_file = self._read(name, "postings").groupBy("f", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        by_file.write.option("compression", "zstd").parquet(f"{self.path}/{name}/file_terms")
        by_file = self._read(name, "file_terms")
        by_file.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).write.parquet(f"{self.path}/{name}/terms")
        sizes = by_file.groupBy("f").agg(F.sum("cf").alias("n_tokens"))
        docs_of.join(sizes, "f", "left").select("f", "n_docs", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens")).write.parquet(f"{self.path}/{name}/files")

    def _read(self, segment: str, table: str) -> DataFrame:
        return self._all([segment], table)

    def update(self, docs: DataFrame, id: str, text: str) -> str:
        """The generation that tells of docs as they are: the newest, or a new one. Reads the files that are not indexed yet, and no others."""
        now = corpus_files(docs)
        while True:
            old = self.newest()
            known = self.files(old)
            live = known.filter("live")
            fresh = [r["path"] for r in now.join(live, "f", "left_anti").select("path").collect()]  # names of files
            gone = live.join(now, "f", "left_anti")
            if old is not None and not fresh and gone.isEmpty():
                return old
            made = [self._added(docs, now.join(live, "f", "left_anti"), None if old is None else fresh, id, text)] if fresh or old is None else []
            if self._publish(old, known, now, gone, made):
                self._tidy()
                return self.newest()

    def _added(self, docs: DataFrame, files: DataFrame, names: list[str] | None, id: str, text: str) -> tuple[str, DataFrame]:
        """A segment of the files of docs that are new (names; all if None)."""
        rows = docs if names is None else docs.filter(F.col("_metadata.file_path").isin(names))
        f = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")
        count = rows.select(f).groupBy("f").agg(F.count("*").alias("n_docs"))
        name = self._write_segment(_postings(rows, id, text, f), count)
        return name, files.select("path", "f").withColumn("segment", F.lit(name))

    def _publish(self, old: str | None, known: DataFrame, now: DataFrame, gone: DataFrame, made: list[tuple[str, DataFrame]]) -> bool:
        """Writes the next generation; False, and nothing is left, if another writer was first."""
        kept_ = known.join(gone.select("f", F.lit(True).alias("gone")), "f", "left").select("path", "f", "segment", (F.col("live") & F.col("gone").isNull()).alias("live"))
        rows = kept_
        for name, files in made:
            rows = rows.unionByName(files.withColumn("live", F.lit(True)))
        alive = rows.filter("live").select("segment").distinct()
        rows = rows.join(F.broadcast(alive), "segment", "left_semi").select("path", "f", "segment", "live")  # a segment without live files goes as a whole
        number = 0 if old is None else int(old.split("-")[1]) + 1
        draft, final = f"{self.path}/draft-{uuid.uuid4().hex}", f"{self.path}/generation-{number:08d}"
        rows.coalesce(1).write.parquet(draft)
        rows = self.spark.read.parquet(draft)
        if rows.filter("live").select("segment").distinct().count() > MOST_SEGMENTS:
            name, merged = self._merged(rows), f"{draft}-merged"
            made.append((name, None))
            rows.filter("live").select("path", "f").withColumns({"segment": F.lit(name), "live": F.lit(True)}).coalesce(1).write.parquet(merged)
            _files(self.spark, draft).delete(_path(self.spark, draft), True)
            draft = merged
        fs, there = _files(self.spark, final), _path(self.spark, final)
        if not fs.exists(there) and fs.rename(_path(self.spark, draft), there):
            return True
        for loser in (draft, *(f"{self.path}/{name}" for name, _ in made)):
            fs.delete(_path(self.spark, loser), True)
        return False

    def _merged(self, rows: DataFrame) -> str:
        """All that is live in one new segment, from postings and counts; no text is read."""
        names = [r[0] for r in rows.filter("live").select("segment").distinct().collect()]  # a few more than MOST_SEGMENTS
        live = F.broadcast(rows.filter("live").select("f"))  # 8 bytes for each file
        every = lambda table: self._all(names, table).join(live, "f", "left_semi")
        return self._write_segment(every("postings"), every("files").select("f", "n_docs"))

    def _tidy(self) -> None:
        """Deletes all generations but the last two, and the segments that only those named."""
        generations = self._names("generation-")
        named = lambda gs: {r[0] for g in gs for r in self.files(g).select("segment").distinct().collect()}
        old = generations[:-2]
        fs = _files(self.spark, self.path)
        for name in [*(named(old) - named(generations[-2:]) if old else ()), *old]:
            fs.delete(_path(self.spark, f"{self.path}/{name}"), True)

    def load(self, generation: str) -> LexicalIndex:
        files = self.files(generation)
        names = [r[0] for r in files.select("segment").distinct().collect()]  # at most MOST_SEGMENTS
        if not names:
            return of(self.spark.createDataFrame([], "doc_id long, text string"))
        dead = files.filter("not live").select("f")
        stats = self._all(names, "files").join(F.broadcast(files.filter("live").select("f")), "f", "left_semi").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        stats = stats.select("n_docs", "n_tokens", F.try_divide("n_tokens", "n_docs").alias("avgdl"))
        postings, terms = self._all(names, "postings"), self._all(names, "terms")
        some_dead = not dead.isEmpty()
        if some_dead:
            off = self._all(names, "file_terms").join(F.broadcast(dead), "f", "left_semi").select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
            postings, terms = postings.join(F.broadcast(dead), "f", "left_anti"), terms.unionByName(off)
        if some_dead or len(names) > 1:
            terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")
        return LexicalIndex(postings.select("doc_id", "term", "tf", "dl", "h", "bucket"), terms, stats)

    def _all(self, names: list[str], table: str) -> DataFrame:
        paths = [f"{self.path}/{n}/{table}" for n in names]
        if table != "postings":
            return self.spark.read.parquet(*paths)
        return functools.reduce(DataFrame.unionByName, (self.spark.read.schema(self.schema).parquet(p) for p in paths))  # each with its own folders


def kept(docs: DataFrame, id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """The index of docs read straight from files: made at first use, found again in the shared folder, brought up to date where files have changed.

    Its place follows the folders that docs are read from, and the columns.
    """
    spark = docs.sparkSession
    roots = sorted({f.rpartition("/")[0] for f in docs.inputFiles()})
    place = spark.range(1).select(F.sha2(F.lit("\n".join([FORMAT, id, text, *roots])), 256)).first()[0]
    store = Segments(spark, f"{sessions.shared_folder(spark)}/lexical-index-{place[:32]}", docs.schema[id].dataType.simpleString())
    return store.load(store.update(docs, id, text))


def _path(spark: SparkSession, name: str):
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)) if "://" in name or name.startswith("file:") else jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
