"""Snapshots as files: what is read is what was written, and what was changed is told."""

from __future__ import annotations

import json
from pathlib import Path
from types import SimpleNamespace

import pytest

from pyspark.sql import functions as F

from sparkloom.plans import checks
from sparkloom.sources import snapshots, specs


def rows(spark):
    spec = {"app": {"actions": [{"name": "A|B", "label": None, "parameters": [{"name": "é", "default": None}, {"name": "x", "max": 5}]}]}}
    return specs.compile_specs(spark.createDataFrame([("one", "1", json.dumps(spec)), ("two", "1", json.dumps(spec)), ("bad", "1", "{")], "app_slug string, app_version string, raw string"))


def lines(folder: Path) -> list[Path]:
    return [p for p in (folder / "rows").glob("part-*") if p.read_text()]


def without_checksums(folder: Path) -> None:
    for p in folder.rglob(".*.crc"):
        p.unlink()


def test_a_snapshot_is_read_as_it_was_written(spark, tmp_path):
    out = rows(spark)
    path = snapshots.write(out, f"file://{tmp_path}/a")
    assert sorted(map(tuple, snapshots.read(spark, path).collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    assert snapshots.problems(spark, path).collect() == []
    with pytest.raises(Exception):  # noqa: B017  Spark's own error: the folder is there
        snapshots.write(out, path)


def test_changed_missing_and_added_rows_are_told(spark, tmp_path):
    path = snapshots.write(rows(spark).coalesce(1), f"file://{tmp_path}/b")
    without_checksums(tmp_path / "b")
    held = [line for f in lines(tmp_path / "b") for line in f.read_text().splitlines()]
    for f in lines(tmp_path / "b")[1:]:
        f.unlink()
    first = lines(tmp_path / "b")[0]
    kept = [line.replace('"x"', '"y"') for line in held if json.loads(line)["app_slug"] == "one"]
    first.write_text("\n".join([*kept, *[line.replace('"two"', '"three"') for line in held if json.loads(line)["app_slug"] == "two"]]) + "\n")
    assert sorted(map(tuple, snapshots.problems(spark, path).collect())) == [("one", "1", "row_changed"), ("three", "1", "row_unlisted"), ("two", "1", "row_missing")]
    with pytest.raises(ValueError, match="not as it was written"):
        snapshots.read(spark, path)


def test_a_snapshot_without_its_end_is_none(spark, tmp_path):
    path = snapshots.write(rows(spark), f"file://{tmp_path}/c")
    without_checksums(tmp_path / "c")
    end = tmp_path / "c" / "COMPLETE"
    end.write_text("0" * 64)
    assert [r.problem for r in snapshots.problems(spark, path).collect()] == ["manifest_changed"]
    end.unlink()
    assert [r.problem for r in snapshots.problems(spark, path).collect()] == ["incomplete"]


def test_an_empty_catalog(spark, tmp_path):
    path = snapshots.write(rows(spark).limit(0), f"file://{tmp_path}/d")
    assert snapshots.read(spark, path).collect() == []


def test_a_snapshot_is_parsed_once_to_be_held_against_its_manifest(spark, sf_dir, monkeypatch):
    read, lines_of = [], snapshots._lines
    monkeypatch.setattr(snapshots, "_lines", lambda spark, path: read.append(path) or lines_of(spark, path))
    assert checks.catalog_snapshot(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert len(read) == 1


def test_rows_that_writing_lost_are_told(spark, tmp_path, monkeypatch):
    lossy = {"to_json": lambda c, *o: F.replace(F.to_json(c, *o), F.lit('"name":"x"'), F.lit('"name":"y"'))}
    monkeypatch.setattr(snapshots, "F", SimpleNamespace(**{**vars(F), **lossy}))
    path = snapshots.write(rows(spark), f"file://{tmp_path}/e")
    monkeypatch.undo()
    with pytest.raises(ValueError, match="not as it was written"):
        snapshots.fingerprints(spark, path)
