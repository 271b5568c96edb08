"""A log analytics engine on Spark: labelled streams of lines, a compact query language, batch and streaming ingest."""
