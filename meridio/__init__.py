"""A product-analytics engine on Spark DataFrames."""
