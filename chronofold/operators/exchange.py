"""Queries over the sources and sinks: archives written and read back, and JSON objects found in running text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_scan import json_objects
from ..sources.archive import STAMPS, read_zipped, turns_of, write_zipped
from .graph import shared_folder

#: Turns of a session, and of a line: no chat, however long, is one line.
SESSION = 20


def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested chats in ZIP archives, each chat dated in one of five ways, read back as turns with their days."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    session = F.floor(F.col("turn") / F.lit(SESSION))
    moment = F.date_add(F.lit("2025-01-01").cast("date"), F.pmod(F.coalesce("conv_id", F.lit(0)) * 7 + F.col("session"), F.lit(365)).cast("int")).cast("timestamp_ntz") + F.expr("INTERVAL '09:30' HOUR TO MINUTE")
    stamp = F.element_at(F.array(*(F.date_format(moment, s) for s in STAMPS)), (F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(STAMPS))) + 1).cast("int"))
    chats = turns.withColumn("session", F.coalesce(session, F.lit(0))).groupBy("conv_id", "session").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    value = F.to_json(F.struct("conv_id", F.array(F.struct(stamp.alias("date"), "turns")).alias("sessions")))
    folder = f"{shared_folder(spark)}/chats-{uuid.uuid4().hex}"
    write_zipped(chats.select(value.alias("value")), folder, lines=500)
    return turns_of(read_zipped(spark, folder, together=1 << 20))


ARCHIVE = """SELECT conv_id, CAST(DATE '2025-01-01' + CAST(((conv_id * 7 + CAST(floor(turn / 20) AS BIGINT)) % 365) AS INT) * INTERVAL 1 DAY AS DATE)::VARCHAR AS day, turn, role, text FROM conversations"""


def objects_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects in running text: every turn with a whole object, a broken one around a whole one, and braces in strings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plain = F.translate(F.coalesce("text", F.lit("")), "{}", "()")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    mixed = F.concat(plain, F.lit(' {"id": "'), key, F.lit('", "said": {"by": "'), F.col("role"), F.lit('", "list": [1, {"x": "}"}]}}'), plain,
                     F.lit('{"open": {"turn": '), F.col("turn").cast("string"), F.lit('}, "text": "{}" oops '), plain, F.lit("{"))
    found = json_objects(turns.select("conv_id", "turn", mixed.alias("mixed")), "mixed")
    return found.select("conv_id", "turn", "place", (F.col("stop") - F.col("start")).alias("size"), "object")


OBJECTS = """WITH t AS (SELECT conv_id, turn, '{"id": "' || conv_id || '-' || turn || '", "said": {"by": "' || role || '", "list": [1, {"x": "}"}]}}' AS a, '{"turn": ' || turn || '}' AS b FROM conversations),
  o AS (SELECT conv_id, turn, 1 AS place, a AS object FROM t UNION ALL SELECT conv_id, turn, 2, b FROM t UNION ALL SELECT conv_id, turn, 3, '{}' FROM t)
  SELECT conv_id, turn, CAST(place AS INT) AS place, CAST(length(object) AS INT) AS size, object FROM o"""


def queries() -> dict:
    return {"archive_round_trip": archive_round_trip, "objects_in_text": objects_in_text}


def oracle_sql() -> dict[str, str]:
    return {"archive_round_trip": ARCHIVE, "objects_in_text": OBJECTS}
