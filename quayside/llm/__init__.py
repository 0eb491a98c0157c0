"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Nothing else in the package imports this subpackage; the driver contract adds
its queries only when it can be imported.
"""
