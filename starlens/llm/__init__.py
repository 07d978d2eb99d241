"""Operations of a training-data pipeline: token output, archives, filters, near-duplicates.

Nothing else in the library imports this subpackage.
"""
