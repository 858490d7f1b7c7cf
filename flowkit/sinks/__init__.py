"""Where DataFrames go."""
