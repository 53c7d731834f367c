"""Sources and sinks: CSV/parquet readers and writers, and the mapping of the
test tables onto the claim data model (``fixture``)."""
