"""Analytics operators for identity and audience data, as functions from DataFrames to a DataFrame."""
