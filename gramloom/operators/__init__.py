"""Grammar operators over DataFrames."""
