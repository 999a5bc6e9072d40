"""The steps of the analysis, DataFrame to DataFrame."""
