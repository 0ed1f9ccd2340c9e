"""Training-data operators: de-duplication, decontamination, quality, archives, tokenisation and scoring.

Nothing else in the package imports this subpackage.
"""
