"""A PySpark engine for sky-survey detections: ingest, cross-match, enrich and query."""
