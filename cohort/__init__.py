"""cohort: entity-record analytics (profiling, KPIs, risk labels, classifiers,
segments, scoring) expressed as Spark DataFrame plans."""

from cohort.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
