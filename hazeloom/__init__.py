"""Spark-native air-quality feature and estimation engine.

Every operator is a plain ``DataFrame -> DataFrame`` function; see the README for the layout.
"""
