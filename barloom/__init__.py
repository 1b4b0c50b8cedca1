"""barloom: market-series analytics expressed as Spark DataFrame plans.

Every operator takes and returns DataFrames keyed by ``symbol`` so that one job
serves every instrument at once.
"""
