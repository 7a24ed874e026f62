"""Operators for preparing large-scale training data.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries only when
the subpackage is present.
"""
