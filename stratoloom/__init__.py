"""Analytics over source-code and knowledge corpora as functions from DataFrames to DataFrames."""
