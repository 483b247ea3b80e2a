"""Search, hierarchy, incremental maintenance and content search over DataFrames."""
