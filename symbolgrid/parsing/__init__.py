"""Source text to symbols, imports and edits: plain functions over strings, run inside Arrow batches."""
