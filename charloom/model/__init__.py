"""Language models behind a small protocol, with a fake one for offline use."""
