"""Run events as batch tables and as streams."""
