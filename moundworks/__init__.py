"""Pitch analytics expressed as Spark DataFrame transformations.

``sources``    readers for the raw relations and the writers of results
``functions``  column expressions (flags, physics, text cleaning)
``operators``  generic DataFrame operators (rate metric, plus-score, carry scan, ridge, ...)
``plans``      the composed score models, each a function of its input DataFrames
"""
