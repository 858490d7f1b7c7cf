"""Column functions that Spark SQL lacks or spells differently."""
