"""Operations of a training-data pipeline: filters, deduplication, mixing, packing, scoring, archives."""
