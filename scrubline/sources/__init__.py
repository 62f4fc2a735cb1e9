"""Reading and writing tables."""

from .tables import (dedupe_column_names, for_each_table, pick_table,  # noqa: F401
                     read_csv, read_jdbc, read_parquet, read_path, read_table,
                     write_cleaned, write_csv)
