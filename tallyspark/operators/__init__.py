"""DataFrame to DataFrame operators.

They are lazy, except where rows are cut at exact positions (splits, samples, mixing: two small
jobs find the cuts) and where a model is fitted.
"""
