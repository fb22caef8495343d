"""Operations for preparing training data: deduplication, filters, scoring, encoding and archives."""
