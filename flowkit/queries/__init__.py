"""Registered queries over the standard tables, with their SQL for an oracle."""
