"""A Spark engine for bibliographic records: every operator takes and returns DataFrames or Columns."""
