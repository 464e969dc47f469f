"""Campaign-mail analytics as Spark DataFrame transforms."""

__all__ = ["dims", "functions", "operators", "plans", "sources", "streaming"]
