import pytest
from pyspark.sql import functions as F

from meterlight import config
from meterlight.functions import selection, text


def shown(spark, kind, values, make):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(make(F.col("v"))).collect()]


def test_numbers(spark):
    assert shown(spark, "double", [5.0, 0.5, 999.0, 1000.0, 1250.0, 2.5e6, 3e9, -4200.0], text.compact_number) == ["5", "0.5", "999", "1K", "1.3K", "2.5M", "3B", "-4.2K"]
    assert shown(spark, "bigint", [7, 12000], text.compact_number) == ["7", "12K"]
    assert shown(spark, "double", [0.05, 500.4, 1.2e6], text.compact_dollars) == ["$0.05", "$500", "$1.2M"]
    assert shown(spark, "double", [1234.561], text.exact_dollars) == ["$1,234.56"]
    assert shown(spark, "double", [18066.94], text.rounded_dollars) == ["$18,067"]


def test_units(spark):
    energy = lambda pct=None: lambda v: text.scaled(v, text.ENERGY_UNITS, None if pct is None else F.lit(pct))
    assert shown(spark, "double", [2.5e6, 1500.0, 3.0, 0.25, 0.0001], energy()) == ["2.50 MWh", "1.50 kWh", "3.00 Wh", "250.00 mWh", "100.00 µWh"]
    assert shown(spark, "double", [499920.0, 1234.5], energy(40)) == ["500 kWh", "1.2 kWh"]
    assert shown(spark, "double", [2500.0, 0.5], lambda v: text.scaled(v, text.WATER_UNITS)) == ["2.50 kL", "500.00 mL"]
    assert shown(spark, "double", [2500.0, 0.0], lambda v: text.scaled(v, text.CARBON_UNITS)) == ["2.50 kg CO₂e", "0.00 g CO₂e"]
    assert shown(spark, "double", [1000.0], lambda v: text.bracketed(v, text.ENERGY_UNITS, F.lit(20))) == ["~1 kWh (800 Wh – 1.2 kWh) ± 20%"]
    assert shown(spark, "double", [1000.0], lambda v: text.bracketed(v, text.ENERGY_UNITS, F.lit(0))) == ["1.00 kWh"]


def test_selections(spark):
    known = ["a", "b", "c"]
    assert selection.toggle(None, "a", known) == {"b", "c"}
    assert selection.toggle({"b", "c"}, "a", known) is None
    assert selection.toggle({"a"}, "a", known) == set()
    assert [selection.selection_summary("models", s, 3) for s in (None, set(), {"a"})] == ["all 3 models", "0 of 3 models", "1 of 3 models"]
    assert selection.selection_summary("models", None, 0) == "no models"
    df = spark.createDataFrame([(k,) for k in known], "k string")
    assert [df.where(selection.selected(F.col("k"), s)).count() for s in (None, set(), {"a"})] == [3, 0, 1]


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "config.toml"
    monkeypatch.setenv("HOME", "/home/u")
    monkeypatch.setenv(config.VARIABLE, str(path))
    assert config.load().roots == ["/home/u/.claude/projects"]
    assert config.load().region == "us-east-1"
    path.write_text('default_inference_region = "old"\n[ingest]\nclaude_code_root = "~/one"\n')
    assert (config.load().roots, config.load().region) == (["/home/u/one"], "old")
    path.write_text('[inference]\ndefault_inference_region = "new"\n[ingest]\nclaude_code_root = "/one"\nclaude_code_roots = ["/a", "~"]\n')
    assert (config.load().roots, config.load().region) == (["/a", "/home/u"], "new")
    path.write_text("[ingest]\nclaude_code_roots = []\n")
    assert config.load().roots == ["/home/u/.claude/projects"]
    for bad in ("typo = 1", "[ingest]\ntypo = 1"):
        path.write_text(bad)
        with pytest.raises(config.UnknownKey):
            config.load()
    assert config.find("/x") == config.Path("/x")
