"""Operators of a training-data pipeline: one module per operator, the
registered queries in ``queries.py`` and their SQL in ``sql.py``. Nothing
else in the library imports this subpackage."""
