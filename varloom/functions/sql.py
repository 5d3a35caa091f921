"""The engine's scalar functions in SQL: temporary functions whose bodies are expressions.

The optimiser inlines a body, so a call is the same plan as the column expression
of :mod:`varloom.functions.columns`, and no Python worker runs.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

_POSITIVE = "IF({0} <= 0, CAST(raise_error('{1} must be positive') AS DOUBLE), {0})"
_ES = _POSITIVE.format("in_es", "ES")
_HL, _CO = "in_scale * ln(try_divide(in_high, in_low))", "in_scale * ln(try_divide(in_close, in_open))"
#: name -> (arguments, body); all are doubles.  Arguments start with in_, as one that is called
#: like a column of the query breaks the plan where several functions take it.
FUNCTIONS = {
    "log_return": ("in_price, in_before, in_scale", "in_scale * ln(try_divide(in_price, in_before))"),
    "parkinson": ("in_high, in_low, in_scale", f"pow({_HL}, 2) / {4 * math.log(2)!r}D"),
    "garman_klass": ("in_open, in_high, in_low, in_close, in_scale", f"0.5D * pow({_HL}, 2) - {2 * math.log(2) - 1!r}D * pow({_CO}, 2)"),
    "tick_loss": ("in_ret, in_var, in_alpha", "(in_alpha - IF(in_ret <= -in_var, 1D, 0D)) * (in_ret + in_var)"),
    "fz0_loss": ("in_ret, in_var, in_es, in_alpha", f"IF(in_ret <= -in_var, -in_var - in_ret, 0D) / (in_alpha * {_ES}) + in_var / {_ES} + ln({_ES}) - 1D"),
    "qlike": ("in_variance, in_proxy", f"ln({_POSITIVE.format('in_variance', 'variance')}) + in_proxy / in_variance"),
    "variance_mse": ("in_variance, in_proxy", "pow(in_variance - in_proxy, 2)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to spark.sql in this session; returns their names."""
    for name, (arguments, body) in FUNCTIONS.items():
        typed = ", ".join(f"{a} DOUBLE" for a in arguments.split(", "))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({typed}) RETURNS DOUBLE RETURN {body}")
    return list(FUNCTIONS)
