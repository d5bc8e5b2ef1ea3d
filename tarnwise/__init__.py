"""Tarnwise: a Spark-native engine for studying retrieval routing over entity records.

Everything is a DataFrame-to-DataFrame operator; named plans with their ANSI
twins are in :mod:`tarnwise.plans`.
"""
