"""Training-data operators: text, media and corpus jobs beside the gridded-data engine."""
