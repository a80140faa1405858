"""Callers of domains and boundaries.

Sequential per-chromosome algorithms: pixels are cut to the band a caller looks at while still
relational, grouped by chromosome, and handed to numpy as one banded array.  A chromosome's band is
bounded by the genome (bins times depth), whatever the number of contacts.
"""
