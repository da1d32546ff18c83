"""Sources and sinks: parquet tables, file trees, CSV logs, versioned stores."""
