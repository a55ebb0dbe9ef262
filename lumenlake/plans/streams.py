"""Queries that replay a table as a stream, all of it, and return the last state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import vectors as V
from lumenlake.plans.register import query
from lumenlake.plans.views import PAD
from lumenlake.sources.scratch import scratch_dir, table
from lumenlake.streaming import analyses, bursts, jobs


def replay(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant


def run(stream: DataFrame, label: str) -> DataFrame:
    """Run to the end of the input and read the result back; instants become times without a zone, as in the tables."""
    spark, path = stream.sparkSession, f"{scratch_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(stream.schema).parquet(f"{path}/out")
    return done.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in done.dtypes])


@query(sql="SELECT date_trunc('hour', ts) AS start, count(*) AS uploads, CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1", plain=True)
def stream_upload_counts(v, spark, sf_dir):
    shots = replay(spark, sf_dir, "events").select("ts", F.floor(F.col("value") * 10).cast("long").alias("size"))
    return run(jobs.stream_upload_counts(shots, "ts"), "stream-counts")


@query(
    sql="""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 600 SECOND THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o)
    SELECT user_id, min(ts) AS start, count(*) AS shots, arg_max(event_id, struct_pack(s := value, i := event_id)) AS sharpest FROM i GROUP BY user_id, run HAVING count(*) > 1""",
    plain=True,
)
def stream_bursts(v, spark, sf_dir):
    shots = replay(spark, sf_dir, "events").select(F.col("ts").alias("taken_at"), "user_id", F.col("event_id").alias("id"), F.col("value").alias("sharpness"))
    return run(jobs.stream_bursts(shots, gap="10 minutes", key="user_id"), "stream-bursts")


@query(sql="SELECT concat('w', cast(user_id % 50 as varchar)) AS name, max(ts) AS last_seen FROM events GROUP BY 1", plain=True)
def stream_liveness(v, spark, sf_dir):
    beats = replay(spark, sf_dir, "events").select(F.concat(F.lit("w"), (F.col("user_id") % 50).cast("string")).alias("name"), F.col("ts").alias("last_seen"))
    return run(jobs.stream_liveness(beats), "stream-liveness")


@query(sql="SELECT CAST(coalesce(sum(CAST(floor(value * 10) AS BIGINT)) FILTER (event_id % 3 = 0), 0) AS BIGINT) AS freed_bytes FROM events", plain=True)
def stream_freed_bytes(v, spark, sf_dir):
    gone = replay(spark, sf_dir, "events").select(F.floor(F.col("value") * 10).cast("long").alias("size"), (F.col("event_id") % 3 == 0).alias("duplicate"))
    return run(jobs.stream_freed_bytes(gone), "stream-freed")


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query(
    sql="""WITH n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT concat('s', lpad(cast(event_id as varchar), 9, '0')) AS id, user_id % 20 AS camera, ts AS taken, v FROM events, n JOIN e ON k = event_id // 3 % n),
    o AS (SELECT *, CASE WHEN epoch(taken) - epoch(lag(taken) OVER w) <= 600 AND list_inner_product(v, lag(v) OVER w) >= 0.1 THEN 0 ELSE 1 END AS opens FROM s WINDOW w AS (PARTITION BY camera ORDER BY taken, id)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY camera ORDER BY taken, id) AS k FROM o),
    b AS (SELECT id, first(id) OVER (PARTITION BY camera, k ORDER BY taken, id) AS burst, count(*) OVER (PARTITION BY camera, k) AS n, max(epoch(taken)) OVER (PARTITION BY camera, k) AS last FROM g)
    SELECT burst, id FROM b WHERE n > 1 AND last + 600 <= (SELECT epoch_ms(max(ts)) FROM events) / 1000.0 - 600""",
    plain=True,
)
def stream_alike_bursts(v, spark, sf_dir):
    """The runs of each camera that are over at the last watermark."""
    e = table(spark, sf_dir, "embeddings")
    shots = replay(spark, sf_dir, "events").withColumn("k", F.expr(f"event_id div 3 % {max(1, e.count())}")).join(e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("vector")), "k")
    id_ = F.concat(F.lit("s"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    made = bursts.stream_alike_bursts(shots.select(id_.alias("id"), id_.alias("sha256"), F.col("ts").alias("taken"), "vector", (F.col("user_id") % 20).alias("camera")), 600, 0.1, "10 minutes", "camera")
    path, before = f"{scratch_dir(spark)}/alike-bursts-{uuid.uuid4().hex}", spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKS[0], before)
    return spark.read.schema(made.schema).parquet(f"{path}/out")


@query(
    sql=f"""WITH RECURSIVE e AS (SELECT vec_id, vec_id // 2 AS p, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    x AS (SELECT {PAD("p")} AS id, v, p % 3 <> 0 AS faced, concat('2024-', lpad(cast(p * 7 % 1000 as string), 4, '0')) AS at FROM e WHERE vec_id % 2 = 0),
    f AS (SELECT concat({PAD("p")}, '/', cast(vec_id % 2 as string)) AS face, p, v FROM e WHERE p % 3 <> 0 AND p IN (SELECT p FROM e WHERE vec_id % 2 = 0)),
    l AS (SELECT a.face AS a, b.face AS b FROM f a JOIN f b ON a.p <> b.p WHERE list_inner_product(a.v, b.v) >= 0.363),
    reach AS (SELECT face AS node, face AS other FROM f UNION SELECT node, b FROM reach JOIN l ON other = a)
    SELECT 'person' AS kind, node AS a, min(other) AS b, CAST(NULL AS DOUBLE) AS similarity FROM reach GROUP BY node
    UNION ALL SELECT 'subject', CASE WHEN (a.at, a.id) > (b.at, b.id) THEN a.id ELSE b.id END, CASE WHEN (a.at, a.id) > (b.at, b.id) THEN b.id ELSE a.id END, round(least(list_inner_product(a.v, b.v), 0.99), 3)
    FROM x a JOIN x b ON a.id < b.id AND NOT (a.faced AND b.faced) WHERE list_inner_product(a.v, b.v) >= 0.363""",
    plain=True,
)
def stream_analyses(v, spark, sf_dir):
    """Analyses of two embeddings a photo (faces on two photos of three), in two batches by a hash: like subjects, and for each face the first face of its person."""
    e = V.encode_vectors(table(spark, sf_dir, "embeddings"), "embedding").select(F.expr("vec_id div 2").alias("p"), (F.col("vec_id") % 2).alias("side"), F.base64("embedding").alias("v"))
    box = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.5, 0.5)])
    face = F.struct(box.alias("box"), F.col("v").alias("embedding"))
    photo = e.where("side = 0").select("p", F.col("v").alias("clip"), face.alias("one")).join(e.where("side = 1").select("p", face.alias("two")), "p", "left")
    faces = F.when(F.col("p") % 3 != 0, F.filter(F.array("one", "two"), lambda f: f.isNotNull()))
    said = F.to_json(F.struct(F.lit(6).alias("version"), "clip", faces.alias("faces")))
    rows = photo.select(F.expr(PAD("p")).alias("id"), F.concat(F.lit("2024-"), F.lpad((F.col("p") * 7 % 1000).cast("string"), 4, "0")).alias("uploaded_at"), said.alias("json"))
    path = f"{scratch_dir(spark)}/analyses-{uuid.uuid4().hex}"
    rows.repartition(2, F.xxhash64("id")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    size = table(spark, sf_dir, "embeddings").select(F.max(F.size("embedding"))).first()[0] or 1
    analyses.stream_analyses(stream, f"{path}/out", size=size, face_size=size, subject=0.363).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    own = analyses.current_faces(spark, f"{path}/out").select("person_id", F.concat_ws("/", "photo_id", F.element_at(F.split("id", ":"), -1)).alias("a"))
    first = own.groupBy("person_id").agg(F.min("a").alias("b"))
    people = own.join(first, "person_id").select(F.lit("person").alias("kind"), "a", "b", F.lit(None).cast("double").alias("similarity"))
    subjects = spark.read.parquet(f"{path}/out/subjects").select("kind", F.col("photo_a").alias("a"), F.col("photo_b").alias("b"), "similarity")
    return people.unionByName(subjects)
