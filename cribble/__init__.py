"""cribble: screening and weak labelling of text corpora on Spark."""

__version__ = "0.1.0"
