"""labelwright: resolve noisy OCR-style text to known article codes with PySpark."""
