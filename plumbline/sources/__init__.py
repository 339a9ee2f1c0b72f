"""Reading and writing: JSON, parquet, CSV, snapshots."""
