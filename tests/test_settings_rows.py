"""Rows of settings: bounds, keys, modes, presets, languages; logs read back."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import citations
from palimpsest.operators import lookup, validation
from palimpsest.plans import settings
from palimpsest.sources import sinks


def test_clamped_and_keys(spark):
    rows = spark.createDataFrame([(None, None), (float("nan"), ""), (float("-inf"), "  "), (5.0, " own "), (-1.0, "ENV: A "), (0.5, "env:B"), (1.0, "ENV:")], "v double, k string")
    got = rows.select(validation.clamped(F.col("v"), (0.25, 0.0, 2.0)).alias("v"), validation.resolved_key(F.col("k"), {"A": "a"}).alias("k")).collect()
    assert [r.v for r in got] == [0.25, 0.25, 0.25, 2.0, 0.0, 0.5, 1.0]
    assert [r.k for r in got] == ["", "", "", "own", "a", "", ""]
    assert rows.select(validation.resolved_key(F.col("k"), {}).alias("k")).collect()[3].k == "own"


def test_key_of_settings(monkeypatch):
    monkeypatch.setenv("SOME_KEY", "x")
    assert settings.from_json('{"apiKey": "env: SOME_KEY "}').key == "x" and settings.from_json('{"apiKey": " y "}').key == "y"
    assert settings.from_json('{"citationStyle": "With-Space"}').citation_style == "with_space" and settings.from_json('{"citationStyle": "else"}').citation_style == "auto"


@pytest.mark.parametrize(("raw", "mode", "style"), [("off", "off", None), (None, "auto", "with_space"), ("WITH-SPACE", "with_space", "with_space"), (" withoutSpace", "without_space", "without_space"), ("with space", "auto", "with_space")])
def test_modes(spark, raw, mode, style):
    row = spark.createDataFrame([(raw,)], "raw string").select(citations.style_mode(F.col("raw")).alias("m"), citations.resolved_style(citations.style_mode(F.col("raw")), F.lit(1), F.lit(1)).alias("s")).first()
    assert (row.m, row.s) == (mode, style)


def test_presets(spark):
    asked = spark.createDataFrame([(1, "de", " x "), (2, "de", None), (3, "de", "x"), (4, "fr", "x"), (5, "de", "x")], "k int, language string, active_id string")
    presets = spark.createDataFrame([(1, 1, "default-de", "de", "a"), (1, 2, "X", "de", "b"), (1, 0, "x", "en", "c"), (2, 1, "y", "de", "d"), (2, 2, "DEFAULT-de", "de", "e"), (3, 5, "z", "de", "f"), (3, 4, None, "de", None), (4, 1, "x", "de", "g")], "k int, n int, id string, locale string, value string")
    got = lookup.active_presets(asked, presets, ["k"], F.lit("new")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "de", "X", "b", False), (2, "de", "DEFAULT-de", "e", False), (3, "de", None, None, False), (4, "fr", "default-fr", "new", True), (5, "de", "default-de", "new", True)]


def test_languages(spark):
    rows = spark.createDataFrame([(" DE ", "fr"), ("de", "unknown"), ("Latin ", None), (None, "de"), ("ga", "mt")], "t string, ui string")
    got = [r.display_name for r in lookup.language_display_names(rows, "t", "ui").collect()]
    assert sorted(map(str, got)) == sorted(["allemand", "German", "Latin", "None", "Irlandiż"])
    names = lookup.language_names(spark)
    assert names.count() == 576 and names.where("name = target or name = ''").count() == 0


def test_logs(spark, tmp_path, monkeypatch):
    assert sinks.logged(spark, str(tmp_path / "none")).count() == 0
    monkeypatch.setattr(sinks, "LOG_BYTES", 1)
    for k in range(6):
        sinks.log_events(spark.createDataFrame([(k, k, "e", "d")], "event_id long, ts_ms long, event string, details string"), str(tmp_path / "log"))
    assert sorted(r.event_id for r in sinks.logged(spark, str(tmp_path / "log")).collect()) == [2, 3, 4, 5]
