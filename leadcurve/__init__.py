"""leadcurve: conversion funnels and ad performance as Spark jobs.

Sub-packages
    functions   column expressions (rounding, money, ratios, actions, text)
    operators   DataFrame -> DataFrame steps
    sources     input schemas, dimension seeds, table readers and writers
    streaming   Structured Streaming jobs
    plans       whole queries wired to the driver tables, with their SQL checks
"""
