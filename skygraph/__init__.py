"""Galaxy catalogues, spatial graphs and training-data operators on Spark DataFrames."""
