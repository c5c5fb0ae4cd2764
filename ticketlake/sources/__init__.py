"""Inputs and sinks: the ticket table derived from the driver tables, CSV and
Parquet readers, snapshots, metadata records."""
