"""Catalogue and feature services as Python data sources, fed by recorded JSON responses, and the item mapping."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.timeparts import parse_iso

ITEM = (
    "id string, assets map<string,string>, geometry string, properties struct<acquired:string,item_type:string,satellite_id:string,instrument:string,clear_percent:double,"
    "cloud_cover:double,quality_category:string,ground_control:boolean,publishing_stage:string,satellite_azimuth:float,sun_azimuth:float,sun_elevation:float,view_angle:float>"
)
#: Names of assets in the catalogue.
EIGHT_BAND, REFLECTANCE = "basic_analytic_8b", ("ortho_analytic_4b_sr", "ortho_analytic_sr")


def search_filter(start: str, end: str, geometry: dict | None = None, item_types: tuple[str, ...] = (), asset: str | None = None, stage: str | None = None, standard_only: bool = True) -> dict:
    """Conjunction of the filters that a search sends: area, dates [start, end), item type, asset, stage, quality."""
    parts: list[dict] = [{"type": "DateRangeFilter", "field_name": "acquired", "config": {"gte": start, "lt": end}}]
    if geometry:
        parts.append({"type": "GeometryFilter", "field_name": "geometry", "config": geometry})
    if item_types:
        parts.append({"type": "StringInFilter", "field_name": "item_type", "config": list(item_types)})
    if asset:
        parts.append({"type": "AssetFilter", "config": [asset]})
    if stage:
        parts.append({"type": "StringInFilter", "field_name": "publishing_stage", "config": [stage]})
    if standard_only:
        parts.append({"type": "StringInFilter", "field_name": "quality_category", "config": ["standard"]})
    return {"type": "AndFilter", "config": parts}


def passes(item: dict, conditions: dict) -> bool:
    """The same conjunction on a recorded item (areas are left to the spatial join)."""
    if conditions["type"] == "AndFilter":
        return all(passes(item, c) for c in conditions["config"])
    if conditions["type"] == "DateRangeFilter":
        at = item["properties"][conditions["field_name"]]
        return conditions["config"]["gte"] <= at < conditions["config"]["lt"]
    if conditions["type"] == "StringInFilter":
        return item["properties"].get(conditions["field_name"]) in conditions["config"]
    if conditions["type"] == "AssetFilter":
        return any(a in item.get("assets", {}) for a in conditions["config"])
    return True


class _Cell(InputPartition):
    def __init__(self, cell: int, path: str):
        self.cell, self.path = cell, path


class CatalogueSource(DataSource):
    """Recorded searches: option ``responses`` is JSON {cell id: path of a JSON-lines file}, ``filter`` a search filter.

    One partition per cell; rows are (cell_id, item as JSON). ``limit`` bounds the items of a cell as the service does. A file
    that is missing and a line that is no JSON raise an error; with ``broken`` set to ``report`` they give a row with the
    reason, ``{"error": ..., "path": ..., "line": ...}``, and reading goes on: ``failures`` selects these rows. Paths are
    opened on the executors and must be on a file system that they all mount.
    """

    @classmethod
    def name(cls) -> str:
        return "scene_catalogue"

    def schema(self) -> str:
        return "cell_id bigint, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CatalogueReader(dict(self.options))


class _CatalogueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Cell(int(c), p) for c, p in sorted(json.loads(self.options["responses"]).items(), key=lambda x: int(x[0]))]

    def read(self, part: _Cell) -> Iterator[tuple]:
        conditions = json.loads(self.options["filter"]) if self.options.get("filter") else None
        limit, n = int(self.options.get("limit", 0)), 0
        report = self.options.get("broken", "fail") == "report"

        def broken(error: Exception, line: int | None) -> tuple:
            if not report:
                raise ValueError(f"{part.path}, line {line}: {error}") from error
            return part.cell, json.dumps({"error": f"{type(error).__name__}: {error}", "path": part.path, "line": line})

        try:
            lines = open(part.path, encoding="utf-8")
        except OSError as e:
            yield broken(e, None)
            return
        with lines:
            for k, line in enumerate(lines, 1):
                try:
                    item = json.loads(line)
                except ValueError as e:
                    yield broken(e, k)
                    continue
                if conditions is None or passes(item, conditions):
                    yield part.cell, json.dumps(item)
                    n += 1
                    if limit and n >= limit:
                        return


def failures(items: DataFrame, raw: str = "item") -> DataFrame:
    """``cell_id, error, path, line`` of what a catalogue read with ``broken`` set to ``report`` could not read."""
    found = F.from_json(raw, "error string, path string, line bigint")
    return items.select("cell_id", found.alias("f")).where("f.error is not null").select("cell_id", "f.*")


class FeaturePages(DataSource):
    """Recorded pages of feature collections: option ``pages`` is JSON [[collection, offset, path], …], one partition each."""

    @classmethod
    def name(cls) -> str:
        return "feature_pages"

    def schema(self) -> str:
        return "collection string, offset bigint, feature string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagesReader(dict(self.options))


class _Page(InputPartition):
    def __init__(self, collection: str, offset: int, path: str):
        self.collection, self.offset, self.path = collection, offset, path


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Page(*x) for x in json.loads(self.options["pages"])]

    def read(self, part: _Page) -> Iterator[tuple]:
        with open(part.path, encoding="utf-8") as f:
            for feature in json.load(f).get("features", []):
                yield part.collection, part.offset, json.dumps(feature)


def page_offsets(total: int, size: int) -> list[int]:
    return list(range(0, total, size))


def asset_name(item_type: str, asset_type: str) -> str:
    # Names of assets in the catalogue.
    known = {
        ("PSScene", "ortho_sr"): "ortho_analytic_4b_sr",
        ("PSScene", "ortho"): "ortho_analytic_4b",
        ("PSScene", "basic"): "basic_analytic_4b",
        ("SkySatCollect", "ortho_sr"): "ortho_analytic_sr",
        ("SkySatCollect", "ortho"): "ortho_analytic",
        ("SkySatCollect", "ortho_pansharpened"): "ortho_pansharpened",
    }
    if (item_type, asset_type) not in known:
        raise ValueError(f"no asset {asset_type!r} of {item_type!r}")
    return known[item_type, asset_type]


def _present(assets: Column, *names: str) -> Column:
    return F.coalesce(F.reduce(F.array(*[F.lit(n) for n in names]), F.lit(False), lambda a, n: a | F.map_contains_key(assets, n)), F.lit(False))


def items_to_scenes(items: DataFrame, raw: str = "item") -> DataFrame:
    """Scenes (without WKB) of raw JSON items, with the defaults of absent attributes."""
    p = lambda n: F.col(f"i.properties.{n}")
    clear = F.coalesce(p("clear_percent"), 100 - (F.coalesce(p("cloud_cover"), F.lit(0.0)) * 100).cast("int"))
    known = items.select("cell_id", F.from_json(raw, ITEM).alias("i")).where("i.id is not null")
    assets = F.col("i.assets")
    return known.select(
        F.col("i.id").alias("id"), parse_iso(p("acquired")).alias("acquired"), p("item_type").alias("item_type"), p("satellite_id").alias("satellite_id"), F.coalesce(p("instrument"), F.lit("SkySat")).alias("instrument"), "cell_id",
        _present(assets, EIGHT_BAND).alias("has_8_channel"), _present(assets, *REFLECTANCE).alias("has_sr_asset"), clear.cast("float").alias("clear_percent"), p("quality_category").alias("quality_category"), F.coalesce(p("ground_control"), F.lit(True)).alias("ground_control"),
        F.coalesce(p("publishing_stage"), F.lit("finalized")).alias("publishing_stage"), p("satellite_azimuth").alias("satellite_azimuth"), p("sun_azimuth").alias("sun_azimuth"), p("sun_elevation").alias("sun_elevation"), p("view_angle").alias("view_angle"),
    )


def missing_attributes(items: DataFrame, raw: str = "item") -> DataFrame:
    """Presence flags of optional attributes, only of items that lack one."""
    known = items.select(F.from_json(raw, ITEM).alias("i")).where("i.id is not null")
    names = ("instrument", "clear_percent", "cloud_cover", "ground_control", "publishing_stage")
    flags = [F.col(f"i.properties.{n}").isNotNull().alias(n) for n in names] + [F.col("i.assets").isNotNull().alias("assets")]
    rows = known.select(parse_iso(F.col("i.properties.acquired")).alias("acquired"), F.col("i.properties.item_type").alias("item_type"), *flags)
    return rows.where(~F.expr(" and ".join([*names, "assets"])))
