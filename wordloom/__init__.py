"""Etymology data as batch Spark jobs: every operator takes and returns DataFrames."""
