import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tallystream.functions import kernels as K
from tallystream.functions import statistics as S
from tallystream.sources import streams
from tallystream.streaming import ordered
from tallystream.streaming.participation import windowed_participation

SMALL = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    batch = streams.participation(spark, SMALL)
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    q = windowed_participation(live).writeStream.format("memory").queryName("periods").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.period_start, r.events) for r in spark.table("periods").collect()}
    want = {(r.p, r.n) for r in batch.groupBy(F.window(F.col("at").cast("timestamp"), "7 days").start.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def run(spark, batches, schema, face, name, path):
    """The rows that face answers to batches, one file each, in order; a last file moves the watermark on."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1 if i < len(batches) - 1 else 0)  # files are taken by their time
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = face(live).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_e_processes_equal_the_batch_with_rows_out_of_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, at(i / 10), i % 2, rng.randint(0, 1)) for i in range(120)]
    moved = sorted(rows, key=lambda r: r[2] + dt.timedelta(hours=rng.uniform(0, 20)))  # up to 20 hours late
    too_late = [("a", 999, at(0.5), 1, 1)]
    batches = [moved[:40], moved[40:80], moved[80:] + too_late, [("z", 1000, at(400), 0, 0)], [("z", 1001, at(800), 0, 0)]]
    got = run(spark, batches, "experiment string, member_ref long, at timestamp, arm int, y int", lambda x: ordered.e_processes(x, 0.3), "processes", f"{tmp_path}/trials")
    for name in "ab":
        own = spark.createDataFrame([r[1:] for r in rows if r[0] == name], "member_ref long, at timestamp, arm int, y int")
        want = {r.member_ref: (r.t, round(r.s, 9), round(r.e, 9), r.stop) for r in S.e_process(own, 0.3).collect()}
        assert {r.member_ref: (r.t, round(r.s, 9), round(r.e, 9), r.stop) for r in got if r.experiment == name} == want


def test_elo_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        a, b = rng.sample(range(5), 2)
        rows.append((rng.choice("xy"), i, at(i / 8), a, b, rng.random() < 0.2))
    moved = sorted(rows, key=lambda r: r[2] + dt.timedelta(hours=rng.uniform(0, 20)))
    schema = "league string, game long, at timestamp, winner_ref long, loser_ref long, drawn boolean"
    got = run(spark, [moved[:30], moved[30:], [("z", 1000, at(400), 0, 1, False)], [("z", 1001, at(800), 0, 1, False)]], schema, ordered.elo_ratings, "ratings", f"{tmp_path}/games")
    want = {r.game: (round(r.winner_rating, 6), round(r.loser_rating, 6)) for r in K.elo(spark.createDataFrame(rows, schema)).collect()}
    assert {r.game: (round(r.winner_rating, 6), round(r.loser_rating, 6)) for r in got if r.league != "z"} == want
