"""gridloom: analytics over panel sensor series, as Spark DataFrames."""
