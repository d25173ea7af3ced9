"""Training-data operators: ten corpus tools, each a function from DataFrames to a DataFrame."""
