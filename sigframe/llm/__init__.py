"""Operators for corpora of training text.

Every operator reads only the columns it names, so further columns of its input may have any name, and keeps one row
per input row unless its docstring says otherwise. NULL text is empty text.
"""
