"""Pages as a stream: every page is complete in itself, so the batch operators run on each micro-batch."""
