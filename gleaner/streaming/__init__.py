"""Files that arrive: duplicates of what has been seen before, batch by batch."""
