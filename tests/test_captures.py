"""Capture files are written in bounded parts."""

import glob

import __spark_entry__ as entry
from checks import files
from packetloom.sources import capture


def test_capture_files_stay_small(spark, sf_dir, monkeypatch):
    written, read = [], capture.read_captures
    monkeypatch.setattr(files, "CAPTURED", 100, raising=False)
    monkeypatch.setattr(capture, "read_captures", lambda session, path: written.append(path) or read(session, path))
    rows = entry.queries()["capture_files"](spark, sf_dir).count()
    parts = glob.glob(written[0].removeprefix("file:"))
    assert rows == spark.read.parquet(f"{sf_dir}/events.parquet").count() and len(parts) == -(-rows // 100) > 3
