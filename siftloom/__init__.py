"""siftloom: entity resolution, trade-code filtering and corpus preparation on Spark DataFrames."""
