"""The document queue as a stream: files arrive, each content is processed once, failures are retried and then set aside.

Each micro-batch is one foreachBatch call that drops contents that other batches have (an anti-join with their digests), processes
page by page and writes its documents and chunks under its own number. A batch that runs again after a crash writes the same again.
Null texts are left out.

run_pages() is for readers that may be slow, fail or die: it keeps a state of each page. A batch goes in waves, of so many pages of each
document; a wave's results are written before the next begins, and a batch that starts again reads only the pages that no wave has.
Pages are read in a child process of the task, so a reader that raises, dies or doesn't answer costs its own page alone; such a page
comes again with the next wave, and after ATTEMPTS failures it is a dead letter. Waves of a batch grow with its longest document, not
with their number, and each is one job over all documents.
"""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.functions import text as T
from ledgerloom.shipping import ship

ATTEMPTS = 3


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty if it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def process(docs: DataFrame, page_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pages and chunks of texts: (sha, page, seq, chunk)."""
    pages = page_of(docs) if page_of else docs.select("sha", F.posexplode(T.virtual_pages(F.col("text"))).alias("page", "body"))
    return pages.select("sha", "page", F.posexplode(T.chunks(F.col("body"))).alias("seq", "chunk"))


def run_queue(source: DataFrame, out: str, checkpoint: str, page_of: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Processes all that has arrived in source (a stream with ``text``) and stops; run again to go on where it stopped."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        ship(spark)
        known = existing(spark, f"{out}/documents", "sha string, batch long")
        done = known.filter(F.col("batch") != number).select("sha").distinct()
        texts = df.filter("text IS NOT NULL").withColumn("sha", F.sha2("text", 256))
        new = texts.dropDuplicates(["sha"]).join(done, "sha", "left_anti").persist()
        try:
            process(new.filter("trim(text) <> ''"), page_of).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
            new.select("sha").write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        finally:
            new.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, folder: str, schema: str | StructType = "text string") -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def retry(pages: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages to try again, and those set aside after ATTEMPTS failures. failures: sha, page (one row for each failure)."""
    counts = failures.groupBy("sha", "page").agg(F.count(F.lit(1)).alias("attempts"))
    rows = pages.join(counts, ["sha", "page"], "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return rows.filter(F.col("attempts") < ATTEMPTS), rows.filter(F.col("attempts") >= ATTEMPTS)


def serve(read_page: Callable[[str], str], bodies: list[str], pipe) -> None:
    for body in bodies:
        try:
            answer = read_page(body), None
        except Exception as e:
            answer = None, f"{type(e).__name__}: {e}"[:500]
        pipe.send(answer)


def read_all(read_page: Callable[[str], str], bodies: list[str], seconds: float) -> list[tuple[str | None, str | None]]:
    """Text or error of each page. One child reads on until it dies or is silent for so long; then that page has failed, and the
    next child goes on behind it."""
    fork, out = multiprocessing.get_context("fork"), []
    while len(out) < len(bodies):
        ours, theirs = fork.Pipe(duplex=False)
        child = fork.Process(target=serve, args=(read_page, bodies[len(out) :], theirs))
        child.start()
        theirs.close()
        try:
            while len(out) < len(bodies):
                if not ours.poll(seconds):
                    out.append((None, f"no answer in {seconds:g} s"))
                    break
                out.append(ours.recv())
        except EOFError:
            out.append((None, "the reader died"))
        finally:
            child.kill()
            child.join()
            ours.close()
    return out


RESULT = "sha string, page int, text string, error string"


def read_wave(pages: DataFrame, read_page: Callable[[str], str], seconds: float) -> DataFrame:
    """sha, page, text and error of each of pages (sha, page, body)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = read_all(read_page, frame["body"].tolist(), seconds)
            yield frame[["sha", "page"]].assign(text=[t for t, _ in found], error=[e for _, e in found])

    return pages.select("sha", "page", "body").mapInPandas(run, RESULT)


def left_over(pages: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pages those that have no text yet, with their attempts, and those set aside."""
    done = results.filter("error IS NULL").select("sha", "page").distinct()
    return retry(pages.join(done, ["sha", "page"], "left_anti"), results.filter("error IS NOT NULL").select("sha", "page"))


def run_pages(source: DataFrame, out: str, checkpoint: str, read_page: Callable[[str], str], page_of: Callable[[DataFrame], DataFrame] | None = None, flush: int = 16, seconds: float = 300.0) -> StreamingQuery:
    """Reads all pages of what has arrived in source (a stream with ``text``) and stops; run again to go on where it stopped.

    page_of: pages (sha, page, body) of documents (sha, text), page from 1; by default virtual pages. flush: pages of a document in a wave.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        ship(spark)
        known = existing(spark, f"{out}/documents", "sha string, pages long, batch long")
        done = known.filter(F.col("batch") != number).select("sha").distinct()
        new = df.filter("text IS NOT NULL").withColumn("sha", F.sha2("text", 256)).dropDuplicates(["sha"]).join(done, "sha", "left_anti")
        pages = page_of(new) if page_of else new.select("sha", F.posexplode(T.virtual_pages(F.col("text"))).alias("page", "body")).withColumn("page", F.col("page") + 1)
        pages.select("sha", F.col("page").cast("int"), "body").write.mode("overwrite").parquet(f"{out}/todo/batch={number}")
        todo = spark.read.parquet(f"{out}/todo/batch={number}")
        todo.groupBy("sha").agg(F.count(F.lit(1)).alias("pages")).write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        while True:
            results = existing(spark, f"{out}/waves/batch={number}", f"{RESULT}, wave int")
            wave = (results.agg(F.max("wave")).first()[0] or 0) + 1
            ready, _ = left_over(todo, results)
            first = F.row_number().over(Window.partitionBy("sha").orderBy("page"))
            some = ready.withColumn("_n", first).filter(F.col("_n") <= flush).repartition("sha", "page")
            read_wave(some, read_page, seconds).write.mode("overwrite").parquet(f"{out}/waves/batch={number}/wave={wave}")
            if spark.read.schema(RESULT).parquet(f"{out}/waves/batch={number}/wave={wave}").isEmpty():
                return

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_pages(spark: SparkSession, out: str) -> DataFrame:
    """sha, page and text of all pages that were read."""
    return existing(spark, f"{out}/waves", f"{RESULT}, batch int, wave int").filter("error IS NULL").select("sha", "page", "text")


def dead_letters(spark: SparkSession, out: str) -> DataFrame:
    """sha, page, attempts and the last error of pages that were given up."""
    failed = existing(spark, f"{out}/waves", f"{RESULT}, batch int, wave int").filter("error IS NOT NULL")
    counts = failed.groupBy("sha", "page").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("error", "wave").alias("error"))
    return counts.join(read_pages(spark, out).select("sha", "page"), ["sha", "page"], "left_anti").filter(F.col("attempts") >= ATTEMPTS)


def states(spark: SparkSession, out: str) -> DataFrame:
    """Each document's pages, how many are done, those set aside, and its status: ready once no page is left."""
    done = read_pages(spark, out).groupBy("sha").agg(F.count(F.lit(1)).alias("done"))
    dead = dead_letters(spark, out).groupBy("sha").agg(F.array_sort(F.collect_list("page")).alias("skipped"))
    rows = existing(spark, f"{out}/documents", "sha string, pages long, batch int").select("sha", "pages").join(done, "sha", "left").join(dead, "sha", "left")
    rows = rows.withColumns({"pages_done": F.coalesce("done", F.lit(0)), "skipped": F.coalesce("skipped", F.array().cast("array<int>"))})
    whole = F.col("pages_done") + F.size("skipped") >= F.col("pages")
    return rows.select("sha", "pages", "pages_done", "skipped", F.when(whole, "ready").otherwise("processing").alias("status"))


def in_order(queue: DataFrame) -> DataFrame:
    """The order of work: documents begun first, then the smaller ones. queue: id, status, pages_done, size."""
    return queue.filter("status = 'queued'").orderBy(F.coalesce(F.col("pages_done") > 0, F.lit(False)).desc(), F.col("size").asc_nulls_first(), "id")


def outdated(documents: DataFrame, version: int) -> DataFrame:
    """Finished documents that an older version of the analysis has read; once read again they carry the new one."""
    return documents.filter((F.col("status") == "ready") & (F.coalesce("version", F.lit(0)) < version))


def without_vectors(chunks: DataFrame) -> DataFrame:
    """Chunks to embed: those of finished documents that have no vector yet, in order, numbered into batches of 64."""
    rows = chunks.filter("vec IS NULL AND status = 'ready'")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq"))
    return rows.withColumn("batch", F.floor((at - 1) / 64).cast("int"))


def reminders(tasks: DataFrame, sent: DataFrame, now: str) -> DataFrame:
    """Tasks to remind now: due, open, and not among those sent. Appending the result to sent makes each go out once."""
    due = tasks.filter((F.col("remind_at") <= F.lit(now)) & F.col("status").isin("todo", "doing", "waiting"))
    return due.join(sent.select("id").distinct(), "id", "left_anti")


def brief_due(now: str, at: str, last_day: str | None, hours: int = 3) -> bool:
    """Whether a day's brief goes out: within some hours of its time, once a day. Times are YYYY/MM/DD HH:MM and HH:MM."""
    day, clock = now.split(" ")
    minutes = lambda t: int(t[:2]) * 60 + int(t[3:5])
    return day != last_day and 0 <= minutes(clock) - minutes(at) <= hours * 60
