"""Document-cleaning pipelines for text corpora, declared as stages and compiled to Spark plans."""

__version__ = "0.1.0"
