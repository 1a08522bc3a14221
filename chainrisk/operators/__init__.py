"""DataFrame -> DataFrame analytics, one module per stage of the analysis."""
