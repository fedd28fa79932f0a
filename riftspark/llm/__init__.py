"""Training-data operators: ten text and vector operators for corpora of any size.

Nothing outside this subpackage imports it.
"""
