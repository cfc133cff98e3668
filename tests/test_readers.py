"""JSON files per match, derived tables and fingerprints."""

import json

import pytest
from pyspark.sql import functions as F

from strideframe.operators.events import normalize_events
from strideframe.operators.expectations import ContractError
from strideframe.operators.points import actor_status
from strideframe.sources import readers


def test_event_and_frame_files(spark, tmp_path):
    (tmp_path / "ev").mkdir()
    (tmp_path / "fr").mkdir()
    events = [
        {"id": "a", "index": 1, "timestamp": "00:00:01.250", "type": {"id": 1, "name": "Pass"}, "pass": {"end_location": [1.0, 2.0]}},
        {"id": "b", "index": 2, "timestamp": "00:01:00.000", "type": {"id": 2, "name": "Shot"}},
    ]
    (tmp_path / "ev" / "77.json").write_text(json.dumps(events))
    frames = [{"event_uuid": "a", "freeze_frame": [{"location": [1, 2], "teammate": True, "keeper": False, "actor": True}]}]
    (tmp_path / "fr" / "77.json").write_text(json.dumps(frames))
    ev = readers.read_events(spark, str(tmp_path / "ev"))
    rows = ev.orderBy("ordinal").select("match_id", "ordinal", "id", "pass", F.expr(readers.period_micros("timestamp")).alias("us")).collect()
    assert [(r["match_id"], r["ordinal"], r["id"], r["us"]) for r in rows] == [(77, 0, "a", 1250000), (77, 1, "b", 60000000)]
    assert rows[1]["pass"] is None
    assert "pass_end_location" in normalize_events(ev).columns
    fr = readers.frame_points(readers.read_frames(spark, str(tmp_path / "fr")))
    assert fr.select(F.expr(actor_status()).alias("s")).first()["s"] == "single"


def test_tables_keep_their_revision(spark, tmp_path):
    df = spark.range(5)
    readers.write_tables({"t": df}, str(tmp_path / "o"), "r1")
    back = readers.read_table(spark, str(tmp_path / "o" / "t"), ["id"], "r1")
    assert readers.table_fingerprint(back).first() == readers.table_fingerprint(df.repartition(3)).first()
    with pytest.raises(ContractError):
        readers.read_table(spark, str(tmp_path / "o" / "t"), ["id"], "r2")
    with pytest.raises(Exception):
        readers.write_tables({"t": df}, str(tmp_path / "o"), "r1")
