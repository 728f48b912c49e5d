"""Training-data operators: dedup, tokenising, decontamination, formatting, extraction and scoring.

Nothing else in the library imports this subpackage. ``queries`` registers one
query per operator; every operator module keeps its own general interface.
"""
