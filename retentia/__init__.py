"""retentia: workforce retention-risk analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
