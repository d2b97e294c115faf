"""Customer return-behaviour analytics as Spark jobs.

Everything takes and returns DataFrames; nothing at customer or line grain is
brought to the driver.
"""
