"""learnmill: statistical learning and clustering over Spark DataFrames."""
