"""Millrace: line-and-record analytics as Spark DataFrame plans.

The library has the map / shuffle / sorted-reduce model as composable plans
(``millrace.plans``), text primitives as column expressions
(``millrace.functions``), readers and writers (``millrace.sources``), ready
operators (``millrace.operators``) and file-stream forms of the operators that
have an incremental meaning (``millrace.streaming``).
"""
