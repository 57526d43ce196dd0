"""Tables from files: images, readings of an OCR engine, knowledge bases, labelled boxes."""
