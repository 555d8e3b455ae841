"""Operators for training-data corpora; nothing else in the library imports them.

Input columns that an operator does not use stay or are left out as it says. Columns that clash with those it adds
are replaced; names that begin with _ll_ are the operators' own.
"""
