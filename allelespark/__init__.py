"""allelespark: polygenic-score data processing on Spark DataFrames."""
