"""Search, build, insert, clustering and routing operators over DataFrames."""
