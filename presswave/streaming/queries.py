"""Streams over a directory of Parquet files, run to their end; the results equal the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswave.functions.registry import SQL, query, read
from presswave.operators import phrases, sentiment
from presswave.plans import articles as A
from presswave.plans.enrichment import titled
from presswave.storage import scratch_path
from presswave.streaming import operators as S


def article_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream; ``ts`` as a timestamp, which watermarks need."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return stream.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over what is there and read what it wrote; with the ``path`` of an earlier run it goes on from there."""
    path = path or scratch_path(stream.sparkSession, name)
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").format("parquet").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def uneven_files(spark: SparkSession, sf_dir: str) -> str:
    """The events as four files that are not in the order of time, with a tenth of the rows twice, in different files."""
    path, e = scratch_path(spark, "files"), read(spark, sf_dir, "events")
    for k in (2, 0, 3, 1):
        own = e.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k)
        again = e.filter((F.pmod(F.xxhash64("event_id"), F.lit(4)) == (k + 1) % 4) & (F.col("event_id") % 10 == 0))
        own.union(again).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return path


@query("SELECT event_id, event_type, value FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of an id, in whatever file: those that come soon are dropped by a state that forgets, later ones by the stored rows."""
    rows = S.deduplicated(article_stream(spark, uneven_files(spark, sf_dir)), scratch_path(spark, "dedup"), "event_id", "ts")
    return rows.select("event_id", "event_type", "value")


@query("""SELECT day, count(*) AS n FROM (SELECT unnest(range(greatest(DATE '2024-01-05', ts::DATE - 6), least(DATE '2024-01-25', ts::DATE) + 1, INTERVAL 1 DAY))::DATE AS day FROM events) GROUP BY 1""")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the seven days from each day on: sliding windows, the newest count of each window."""
    path = scratch_path(spark, "sliding")
    rows = article_stream(spark, sf_dir).groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/b={number}")

    rows.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema("day date, n long, batch int").option("recursiveFileLookup", "true").parquet(f"{path}/out")
    return every.groupBy("day").agg(F.max_by("n", "batch").alias("n")).filter("day BETWEEN DATE'2024-01-05' AND DATE'2024-01-25'")


ENRICHED = f"""WITH c AS ({SQL['article_classification']}), r AS ({SQL['location_routing']}), s AS ({SQL['lexicon_sentiment']}), k AS (SELECT doc_id, count(*) AS tags, max(score) AS priority, arg_min(tag, rank) AS tag FROM c GROUP BY 1), n AS (SELECT doc_id, count(*) AS routes FROM r GROUP BY 1)
    SELECT doc_id, coalesce(tags, 0) AS tags, tag, priority, coalesce(routes, 0) AS routes, sentiment FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""


@query(ENRICHED)
def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article is classified, routed and scored as it comes: the batch operators on every batch, beside static tables."""
    docs = read(spark, sf_dir, "documents")
    priors, tags, cities, countries, lexicon = A.tag_priors(docs), A.tag_phrases(spark, sf_dir), A.city_phrases(spark, sf_dir), A.country_phrases(spark, sf_dir), A.lexicon(spark, sf_dir)
    path = scratch_path(spark, "enriched")
    for k in (2, 0, 3, 1):  # four files of uneven sizes
        docs.filter(F.least(F.pmod(F.xxhash64("doc_id"), F.lit(7)), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{path}/files")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/files")

    def enrich(batch: DataFrame) -> DataFrame:
        new = titled(batch)
        best = phrases.classified(new, tags, priors).groupBy("doc_id").agg(F.count("*").alias("tags"), F.min_by("tag", "rank").alias("tag"), F.max("score").alias("priority"))
        placed = A.routes(new, cities, countries).groupBy("doc_id").agg(F.count("*").alias("routes"))
        felt = sentiment.sentiment(A.read_articles(new), lexicon).select("doc_id", "sentiment")
        told = new.select("doc_id").join(best, "doc_id", "left").join(placed, "doc_id", "left").join(felt, "doc_id", "left")
        return told.select("doc_id", F.coalesce("tags", F.lit(0)).alias("tags"), "tag", "priority", F.coalesce("routes", F.lit(0)).alias("routes"), "sentiment")

    return S.enriched(stream, path, enrich)


@query("SELECT count(*) AS attempted, count(*) FILTER (WHERE user_id % 7 <> 0) AS succeeded, count(*) FILTER (WHERE user_id % 7 = 0) AS failed FROM events")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run, added up over a ledger of its batches."""
    return S.counted(article_stream(spark, sf_dir), scratch_path(spark, "counters"), F.col("user_id") % 7 == 0, "event_id")[0]


@query("SELECT event_id FROM events WHERE user_id % 7 = 0")
def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that failed in a run."""
    return S.counted(article_stream(spark, sf_dir), scratch_path(spark, "failures"), F.col("user_id") % 7 == 0, "event_id")[1]


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0) GROUP BY ALL")
def stream_hot_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts over files out of order: days that late rows touch are counted anew from their partitions, others come from the stream."""
    return S.hot_edge(article_stream(spark, uneven_files(spark, sf_dir)), scratch_path(spark, "edge"), "ts", "event_type").counts.withColumnRenamed("kind", "event_type")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days, kept in the state however late data comes; each batch's changed days replace those before."""
    path = scratch_path(spark, "counts")
    counts = article_stream(spark, sf_dir).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    rows = counts.select(F.to_date("window.start").alias("day"), "event_type", "n")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/b={number}")

    rows.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema("day date, event_type string, n long, batch int").option("recursiveFileLookup", "true").parquet(f"{path}/out")
    return every.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT event_id, event_type FROM events")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream stopped after some files and started again when more have come: each file is read once, some files a batch."""
    files, path, e = scratch_path(spark, "files"), scratch_path(spark, "resumed"), read(spark, sf_dir, "events")
    for half in (0, 1):
        e.filter(F.col("event_id") % 2 == half).repartition(3).write.mode("append").parquet(f"{files}/events.parquet")
        out = drained(article_stream(spark, files, 2).select("event_id", "event_type"), "resumed", path=path)
    return out
