"""Where rows come from and go to: versioned tables, CSV files, Parquet views."""

from lattis.sources.csv import read_csv
from lattis.sources.parquet import read_tables
from lattis.sources.storage import Database, TableState

__all__ = ["Database", "TableState", "read_csv", "read_tables"]
