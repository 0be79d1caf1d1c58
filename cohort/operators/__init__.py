"""Table operators: each takes DataFrames (plus small driver-side metadata)
and returns DataFrames."""
