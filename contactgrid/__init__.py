"""Analytics over sparse symmetric contact matrices, as Spark DataFrames."""
