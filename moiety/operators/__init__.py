"""Search and preparation operators on DataFrames."""
