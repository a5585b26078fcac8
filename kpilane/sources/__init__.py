"""Sources and sinks: CSV extracts, Parquet star folders, the driver-table adapter."""

from kpilane.sources.adapter import star_from_tpch
from kpilane.sources.star import (
    export_views,
    load_star,
    materialize_star,
    read_csv_typed,
    role_weights_frame,
    save_star,
    write_csv,
)

__all__ = [
    "export_views",
    "load_star",
    "materialize_star",
    "read_csv_typed",
    "role_weights_frame",
    "save_star",
    "star_from_tpch",
    "write_csv",
]
