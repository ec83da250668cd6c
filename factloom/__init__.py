"""factloom: context-scoped fact analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
