"""Review-trust analytics on Spark DataFrames."""

from plumbline.operators.graph import Graph

__all__ = ["Graph"]
