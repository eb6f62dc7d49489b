"""Operators of a training-data pipeline (mixing, licences, quality, exact and near duplicates,
token output, archives, token counts, decontamination). Nothing else in the library imports this."""
