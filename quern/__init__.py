"""quern: consolidates disagreeing tabular sources into one governed dataset on Spark."""

__version__ = "0.1.0"
