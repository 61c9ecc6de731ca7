"""Entry points for spark-submit."""
