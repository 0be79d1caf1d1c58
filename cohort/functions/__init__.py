"""Column-expression helpers (JVM-side, codegen-friendly; no Python UDFs)."""

from cohort.functions.exprs import (  # noqa: F401
    col, num, is_numeric_type, is_categorical_type, is_datetime_type, row_mean,
    scale_factor, pass_mark, normalize_name, normalize_name_col, r6,
)
from cohort.functions.labels import (  # noqa: F401
    PASS, FAIL, normalize_target, derive_target, risk_category, risk_level,
    attendance_percent, recommendation, confidence_band, is_absence_name,
)
