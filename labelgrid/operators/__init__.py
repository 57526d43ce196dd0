"""Layout operators over tables of OCR boxes, keyed by page (``image_id``)."""
