"""DataFrame operators: schema, filters, dedupe, profiles, vocabularies, splits, memory."""
