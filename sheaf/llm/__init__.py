"""Operations of a training-data pipeline: encoding, filters, deduplication.

Nothing outside this subpackage imports it.
"""
