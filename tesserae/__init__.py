"""tesserae."""
