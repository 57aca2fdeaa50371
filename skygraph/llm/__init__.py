"""Training-data operators: scoring, de-duplication, decontamination, token counts and packing."""
