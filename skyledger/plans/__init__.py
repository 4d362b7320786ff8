"""The jobs: ingest, roll-ups, weekly table, views, publishing."""
