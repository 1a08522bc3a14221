"""Supply-chain risk analytics as Spark DataFrame plans.

Sub-packages
------------
``sources``    table and lexicon readers, sinks, staged tables
``functions``  column-level helpers: null rules, calendar, text, windows
``operators``  DataFrame -> DataFrame analytics
``plans``      the operators wired to concrete input tables
"""
