"""An audit-shaped view of the given ``events`` table, with the dimensions that go with it.

user_id and a third of the month give containers and process trees, event_type and the id give calls, and
props.k gives paths, addresses, queues and commands. All of it is one select over the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.shared import stash

DAY0 = 1_704_067_200_000
GAP_MS = 3_600_000

VIEW = """
SELECT serial, ts_ms, container_id, pid, ppid, syscall, flags, fd, comm, concat('/bin/', comm) AS exe,
  CASE WHEN syscall = 59 AND k % 10 <> 9 THEN CASE WHEN k % 2 = 0 THEN concat('/usr/bin/', comm) END WHEN syscall NOT IN (257, 87, 82, 90, 59) THEN NULL WHEN k = 0 THEN '/etc/passwd'
       WHEN k = 1 THEN '/proc/1/maps' WHEN k = 2 THEN '/usr/lib/libc.so' WHEN k = 3 THEN '/etc/crontab' ELSE concat('/data/d', CAST(k % 10 AS STRING), '/f_', lpad(CAST(k AS STRING), 3, '0'), '.json') END AS path,
  CASE WHEN syscall = 42 THEN CASE WHEN k % 12 = 11 THEN '127.0.0.1:80' ELSE concat('10.0.0.', CAST(k % 12 AS STRING), ':80') END WHEN syscall = 49 THEN CASE WHEN k % 3 = 0 THEN '0.0.0.0:80' ELSE '10.0.0.1:8080' END END AS addr,
  CASE WHEN syscall IN (68, 69, 70) THEN concat('sysv_mq:', CAST(k % 7 AS STRING)) WHEN syscall = 240 THEN concat('posix_mq:/q', CAST(k % 3 AS STRING)) END AS channel,
  CASE WHEN syscall = 59 THEN concat(comm, ' /tmp/job', CAST(k AS STRING), ' http://10.0.0.', CAST(k % 12 AS STRING), '/') END AS cmdline,
  CASE WHEN syscall = 40 THEN fd END AS src_fd, CASE WHEN syscall = 40 THEN 3 + serial div 5 % 5 END AS dst_fd, k
FROM (
  SELECT event_id AS serial, ts_ms, concat('c', CAST(user_id % 8 AS STRING)) AS container_id, 1000 + user_id + 100000 * part AS pid,
    CASE WHEN user_id div 8 = 0 THEN 1 ELSE 1000 + ((user_id div 8 - 1) div 2) * 8 + user_id % 8 + 100000 * part END AS ppid,
    CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 5 = 4 THEN 231 WHEN event_id % 10 = 6 THEN 56 WHEN event_id % 10 = 7 THEN 62 WHEN event_id % 10 = 8 THEN 319 ELSE 59 END
      WHEN 'click' THEN CASE WHEN event_id % 6 = 5 THEN 49 ELSE 42 END WHEN 'purchase' THEN CASE event_id % 10 WHEN 7 THEN 82 WHEN 8 THEN 90 ELSE 257 END
      WHEN 'view' THEN CASE WHEN event_id % 4 = 3 THEN 40 WHEN event_id % 16 = 1 THEN 0 WHEN event_id % 16 = 5 THEN 1 ELSE 257 END
      ELSE CASE event_id % 6 WHEN 0 THEN CASE WHEN k % 25 = 24 THEN 68 ELSE 69 END WHEN 1 THEN 70 WHEN 2 THEN 87 WHEN 3 THEN 240 WHEN 4 THEN 242 ELSE 243 END END AS syscall,
    CASE WHEN event_type = 'purchase' AND event_id % 10 NOT IN (7, 8) THEN 577 ELSE 0 END AS flags, 3 + event_id % 5 AS fd,
    CASE user_id % 5 WHEN 0 THEN 'sh' WHEN 1 THEN 'curl' WHEN 2 THEN 'python3' WHEN 3 THEN 'gcc' ELSE 'nc' END AS comm, k
  FROM (SELECT *, CAST((ts_ms - 1704067200000) div 864000000 AS INT) AS part FROM (
    SELECT *, unix_micros(CAST(ts AS TIMESTAMP)) div 1000 AS ts_ms, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events})))
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VIEW, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def stashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as a table: else Spark repeats its expressions in every filter and column that uses them."""
    return stash(events(spark, sf_dir), "events")


def containers(spark: SparkSession) -> DataFrame:
    return spark.range(8).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("container_id"))


def actions(spark: SparkSession) -> DataFrame:
    """Thirty day-long actions of every container."""
    n = F.col("n")
    days = containers(spark).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))))
    start = F.lit(DAY0).cast("long") + (n - 1) * F.lit(86_400_000)
    return days.select("container_id", n.alias("action_id"), F.concat(F.lit("day "), n).alias("command"), (start + 3_600_000).alias("start_ms"), (start + 79_200_000).alias("end_ms"))


def owners(spark: SparkSession) -> DataFrame:
    return spark.range(8).select(F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("ip"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("container_id"))


def experiments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("exp-1", "first", ["c0", "c1", "c2", "c3"]), ("exp-2", "second", ["c4", "c5", "c6", "c7"])], "experiment_id string, name string, container_ids array<string>")
