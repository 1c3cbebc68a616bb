"""Address index for logs and table columns, declared with the DataFrame API."""

__version__ = "0.1.0"
