"""Errors that name what is wrong with a pipeline or an operator's arguments."""


class ConfigError(ValueError):
    """Arguments that no data can make right: an absent column, an unknown option, a broken graph."""
