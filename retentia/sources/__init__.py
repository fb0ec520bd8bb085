"""Sources and sinks: base-table readers, employee/scored table I/O, metadata, models."""
