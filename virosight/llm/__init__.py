"""Training-data operators: filters, classifiers, near-duplicate and search jobs.

Nothing else in the library imports this subpackage.
"""
