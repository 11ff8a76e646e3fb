"""strandforge: structural-variant studies and corpus pipelines on Spark DataFrames."""
