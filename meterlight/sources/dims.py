"""Price and factor files (TOML) as DataFrames. Configuration-sized, so they are read on the driver."""

from __future__ import annotations

import datetime as dt
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ENV_FACTORS, GRID_FACTORS, PRICING

SUPPORTED_VERSIONS = range(1, 2)
EPOCH = dt.date(1970, 1, 1)
_NULL = re.compile(r"^(\s*[^#=\n]+=\s*null\s*(?:#.*)?)$", re.M)


class UnsupportedVersion(ValueError):
    """The file's schema_version is not one that this library reads."""


def rewrite_null_assignments(text: str) -> str:
    """Comment out lines of the form ``key = null``, which TOML does not know."""
    return _NULL.sub(r"# \1", text)


def _parse(text: str) -> dict:
    data = tomllib.loads(rewrite_null_assignments(text))
    if data.get("schema_version") not in SUPPORTED_VERSIONS:
        raise UnsupportedVersion(f"schema_version {data.get('schema_version')}")
    return data


def _date(value) -> dt.date | None:
    return value if value is None or isinstance(value, dt.date) else dt.date.fromisoformat(value)


def _rows(tables: dict, schema, fixed: tuple[str, ...]) -> list[dict]:
    """Flatten nested maps whose keys are the ``fixed`` columns; unknown entries are ignored."""
    found: list[tuple[dict, dict]] = [({}, tables)]
    for column in fixed:
        found = [({**keys, column: k}, v) for keys, level in found for k, v in sorted(level.items()) if isinstance(v, dict)]
    names = {f.name: f.dataType.typeName() for f in schema}
    out = []
    for keys, values in found:
        row = dict.fromkeys(names)
        for name, value in {**values, **keys}.items():
            if name in names:
                row[name] = _date(value) if names[name] == "date" else float(value) if names[name] == "double" and value is not None else value
        out.append(row)
    return out


class PricingFile:
    """``[providers.<provider>.models.<model>]`` or ``[<provider>.<model>]`` tables below ``models``."""

    def __init__(self, text: str):
        data = _parse(text)
        self.file_status = data.get("file_status", "production")
        self.rows = _rows(_by_provider(data), PRICING, ("provider", "model"))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.rows], PRICING).orderBy("provider", "model")

    @property
    def needs_review(self) -> bool:
        return self.file_status != "production"

    def most_recent_accessed_at(self) -> dt.date | None:
        return max((r["source_accessed_at"] for r in self.rows if r["source_accessed_at"]), default=None)


def _by_provider(data: dict) -> dict:
    tables = data.get("providers", data.get("models", {}))
    return {p: v.get("models", v) if isinstance(v, dict) else {} for p, v in tables.items()}


class FactorsFile:
    """Model factors as in price files, grid factors below ``grid`` (or ``grid_factors``), and defaults."""

    def __init__(self, text: str):
        data = _parse(text)
        self.file_status = data.get("file_status", "production")
        self.models = _rows(_by_provider(data), ENV_FACTORS, ("provider", "model"))
        self.grids = _rows(data.get("grid", data.get("grid_factors", {})), GRID_FACTORS, ("region",))
        self.defaults = data.get("defaults", {})
        for row in self.models:
            row["valid_from"], row["valid_to"] = row["valid_from"] or EPOCH, None
        for row in self.grids:
            row["valid_from"], row["valid_to"] = row["valid_from"] or EPOCH, None
            row["source_accessed_at"] = row["source_accessed_at"] or row["valid_from"]

    @property
    def is_placeholder(self) -> bool:
        """Any status but production is pending."""
        return self.file_status != "production"

    def fallbacks(self) -> tuple[float | None, float | None]:
        return self.defaults.get("fallback_pue"), self.defaults.get("fallback_wue_l_per_kwh")

    def model_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.models], ENV_FACTORS).orderBy("provider", "model")

    def grid_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.grids], GRID_FACTORS).orderBy("region")

    def most_recent_grid_accessed_at(self) -> dt.date | None:
        return max((r["source_accessed_at"] for r in self.grids if r["source_accessed_at"]), default=None)

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """All factors as one table: kind (model, grid), then provider and model, or region, in their order."""
        models = self.model_frame(spark).withColumn("kind", F.lit("model"))
        both = models.unionByName(self.grid_frame(spark).withColumn("kind", F.lit("grid")), allowMissingColumns=True)
        return both.orderBy(F.desc("kind"), "provider", "model", "region")

    def counts(self) -> dict[str, int]:
        rates = [f.name for f in ENV_FACTORS if f.name.startswith("wh_per_mtok_")]
        return {"models": len(self.models), "regions": len(self.grids), "all_null_models": sum(all(r[c] is None for c in rates) for r in self.models)}


def visible_factors(snapshot: DataFrame, models: DataFrame, region: str) -> DataFrame:
    """Of a snapshot the rows of the models in a chart, and the region's."""
    shown = snapshot.where("kind = 'model'").join(F.broadcast(models.select("model").distinct()), "model", "left_semi")
    return shown.unionByName(snapshot.where((F.col("kind") == "grid") & (F.col("region") == region)))


def load_text(spark: SparkSession, path: str) -> str:
    """A configuration file, from any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def sentinels_to_null(grids: DataFrame) -> DataFrame:
    """Older grid rows used 0.0 carbon and a PUE of 1.0 for unknown."""
    return grids.withColumns({
        "co2e_kg_per_kwh": F.when(F.col("co2e_kg_per_kwh") != 0.0, F.col("co2e_kg_per_kwh")),
        "pue": F.when(F.col("pue") != 1.0, F.col("pue")),
    })


def sync_environmental_factors(file: FactorsFile, spark: SparkSession, folder: str) -> dict[str, int]:
    """Replace both factor tables below ``folder`` and return the counts."""
    file.model_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/env_factors")
    file.grid_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/grid_factors")
    return file.counts()
