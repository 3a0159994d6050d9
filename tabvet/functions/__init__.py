"""Column-expression kernels shared by the operators."""

from tabvet.functions.hashing import hu, hu_sql, normal_draw
from tabvet.functions.normal import phi, phi_inv, phi_sql, phi_inv_sql
from tabvet.functions import t3

__all__ = ["hu", "hu_sql", "normal_draw", "phi", "phi_inv", "phi_sql",
           "phi_inv_sql", "t3"]
