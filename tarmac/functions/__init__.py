"""Column-expression helpers (JVM-side, codegen-friendly)."""

from tarmac.functions.columns import (  # noqa: F401
    money_double, money_sum, money_total, ratio, month_key, month_start, months_between_starts, quarter_label, truncate_label,
)
from tarmac.functions.stats import t_two_sided_p  # noqa: F401,E402
