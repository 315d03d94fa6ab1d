"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames, names its columns by parameter and reads only the columns
it needs, so further columns of any name do no harm. `catalog` registers one
query for each operator.
"""
