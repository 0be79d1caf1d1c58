"""Query catalog: every operator as a (spark, sf_dir) -> DataFrame callable,
paired with DuckDB SQL that computes the same result for the parity check."""
