"""Weather-feed analytics on Spark: ingest, archive, latest state, views, publish."""
