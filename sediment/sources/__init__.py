"""Reading files whole, by prefix, and by byte ranges."""
