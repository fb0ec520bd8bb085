"""Named query plans (the catalogue registered in __spark_entry__) and their DuckDB oracles."""
