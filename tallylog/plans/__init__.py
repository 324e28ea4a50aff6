"""Tables, limits, the store of parsed results, and the demo tables."""
