"""Operators for training-data pipelines over the tables ``documents``, ``pages``,
``benchmark`` and ``labels``. Nothing else in the library imports this subpackage."""
