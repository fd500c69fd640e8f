"""tallyroom: public-finance audit analytics on Spark DataFrames."""
