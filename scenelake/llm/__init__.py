"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it. Every operator takes DataFrames, reads only the
columns named in its arguments and returns a DataFrame. Input columns of any other name never clash with what it works
with; where it adds columns to the input, one that has the name of an added column is replaced.
"""
