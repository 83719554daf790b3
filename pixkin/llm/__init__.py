"""Operators of a training-data pipeline: quality, licences, secrets, mixing, sharding, packing,
near duplicates, archives, tries, language models and phrases.  Nothing else in the library imports this subpackage."""
