"""Files in and out, and the mapping of the star-schema test tables."""
