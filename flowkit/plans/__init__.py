"""Pipelines: graphs of sources, transforms and sinks."""
