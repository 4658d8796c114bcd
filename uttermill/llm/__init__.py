"""Operators for training-data pipelines over web-scale text.

One module per operator; ``queries`` holds the registered queries and
``oracle`` their SQL. Nothing else in the library imports this subpackage.
"""
