"""Scans, file formats of the geospatial side tables, recorded catalogue responses, and sinks."""

from .catalogue import CatalogueSource, FeaturePages, items_to_scenes, missing_attributes  # noqa: F401
from .files import bad_files, containing, geojson_features, GeoPackageSource, scan, scan_union, scan_years, table_by_suffix  # noqa: F401
from .sinks import hex_path, remaining, write_cells, write_csv, write_geojson  # noqa: F401
