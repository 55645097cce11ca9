"""Climate-impact analytics for electricity grids, written as Spark DataFrame transformations."""
