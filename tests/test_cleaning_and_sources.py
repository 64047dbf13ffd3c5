import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lorewright.functions import grounding
from lorewright.operators import cleaning
from lorewright.sources import artifacts
from lorewright.streaming import events


def test_furniture_goes_and_body_stays(spark):
    pages = [(1, p, f"The Adventure Guide\nBody of page {p} goes-\non here.\n12\nLast words.\n- {p} -\nDownloaded by reader {p}") for p in (1, 2, 3)]
    pages += [(2, 1, "The Adventure Guide\nonly page"), (3, 1, None), (3, 2, "")]
    df = spark.createDataFrame(pages, "document_id long, page long, text string")
    got = {(r.document_id, r.page): (r.model_text, r.removed) for r in cleaning.clean_pages(df).collect()}
    assert got[1, 2] == ("Body of page 2 goeson here. 12 Last words.", 3)
    assert got[2, 1] == ("The Adventure Guide only page", 0) and got[3, 1] == got[3, 2] == ("", 0)
    reasons = {(r.line_no, r.reason) for r in cleaning.marked_lines(df.where("document_id = 1")).where("reason IS NOT NULL").collect()}
    assert reasons == {(0, "recurring_header"), (5, "page_ornament"), (6, "watermark")}


def test_names_are_grounded_exactly_or_by_stems():
    page = "In the keep, Lord Ármand the Bold opened the ancient vaults during the siege of Blackwater."
    a = grounding.ground("lord armand", "npc", page)
    assert a[0] == "exact" and page[a[1] : a[2]] == "Lord Ármand"
    assert grounding.ground("Opening the Ancient Vaulted halls", "npc", page)[0] is None
    assert grounding.ground("Blackwaters ancients", "quest", page)[0] == "inferred"
    assert grounding.ground("", "npc", page)[0] is None
    assert grounding.plain("Ça, «va»—bien!") == "ca va bien"


def test_campaign_json_artifacts_and_logs(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"title": "T", "pages": ["one", "two"]}, indent=1))
    assert [(r.page, r.text) for r in artifacts.read_campaign(spark, str(tmp_path / "c.json")).orderBy("page").collect()] == [(1, "one"), (2, "two")]
    out = str(tmp_path / "once")
    artifacts.write_once(spark.range(3).toDF("k"), out)
    with pytest.raises(Exception, match="exists"):
        artifacts.write_once(spark.range(3).toDF("k"), out)
    log = str(tmp_path / "log")
    for _ in range(2):
        artifacts.append_log(spark.range(2).toDF("k"), log)
    assert spark.read.parquet(log).count() == 4
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"abc")
    (folder / "b.txt").write_bytes(b"abd")
    h = hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame([("a.txt", 3, h), ("b.txt", 3, h), ("c.txt", 1, h), ("../a.txt", 3, h), ("a2.txt", 3, h), ("a2.txt", 3, h)], "name string, bytes long, sha256 string")
    good, bad = artifacts.verified_files(spark, str(folder), manifest)
    assert [r.name for r in good.collect()] == ["a.txt"]
    assert {(r.name, r.reason) for r in bad.collect()} == {("b.txt", "wrong hash"), ("c.txt", "missing"), ("../a.txt", "path leaves the folder"), ("a2.txt", "named twice")}


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    query = events.counts_by_window(events.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = src.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert spark.table("w").agg(F.sum("events"), F.count(F.lit(1))).first() == want.agg(F.sum("n"), F.count(F.lit(1))).first()
