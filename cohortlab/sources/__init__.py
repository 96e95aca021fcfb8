"""Sources and sinks: table scans, snapshots, versioned appends, TSV, literal tables, SQL templates."""
from .io import (  # noqa: F401
    append_version, cached, enforce_schema, literal_table, read_table, read_tsv, read_version,
    register_tables, run_sql, snapshot, snapshot_upto, write_bundle, write_tsv,
)
