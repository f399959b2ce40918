"""Column functions of the dialect that Spark has no single function for."""

from lattis.functions.arithmetic import assigned
from lattis.functions.text import float_text

__all__ = ["assigned", "float_text"]
