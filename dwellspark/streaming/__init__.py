"""The ingest flow over a landing folder."""
