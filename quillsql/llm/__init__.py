"""Training-data operators. Nothing outside this subpackage (and its tests) imports it."""
