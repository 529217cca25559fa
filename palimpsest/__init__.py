"""Text-revision analytics on Spark: paragraphs, batches, corrections, diffs and revisions as DataFrame operators."""
