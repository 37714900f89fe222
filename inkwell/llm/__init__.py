"""Operators of a training-data pipeline: language ID, near duplicates,
decontamination, personal data, packing, sharding, fingerprints, chat
formatting, page extraction and repeated-substring removal.

Nothing else in the library imports this subpackage."""
