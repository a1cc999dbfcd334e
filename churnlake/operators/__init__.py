"""Operators: DataFrame in, DataFrame out.

Functions that need a fitted value run one small aggregate and keep only that value on the driver.
"""
