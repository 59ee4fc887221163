"""The query catalogue: every operator on the driver's tables, with its DuckDB oracle."""
