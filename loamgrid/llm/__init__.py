"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Every operator works on whole tables
and whole texts, and every intermediate table goes to the folder that all
executors share (see :mod:`loamgrid.llm.common`).
"""
