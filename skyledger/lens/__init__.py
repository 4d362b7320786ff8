"""Weather rows and payloads derived from the driver tables."""
