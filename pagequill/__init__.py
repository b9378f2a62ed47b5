"""Site-audit analytics and corpus preparation on Spark DataFrames."""
